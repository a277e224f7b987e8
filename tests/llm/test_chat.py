import hashlib
import random

from pyspark.sql import functions as F

from sparkloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, examples string"


def rows():
    rnd = random.Random(9)
    bits = ["\\", "<", "|", "\n", "<|", "<\\|", "<|im_end|>\n", "<|im_start|>", "assistant", "n", "é", "𝄞", " ", "<\\n"]
    out = []
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            out.append((c, t, rnd.choice(["user", "assistant", "system", "a\\n<\nb", None]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))]), "x"))
    out += [(100, None, "assistant", "first", None), (100, 1, "user", "u", None), (100, 1, "user", "u", None), (None, 0, "assistant", chat.ODD, None)]
    return out


def ordered(data):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_round_trip_and_digests(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in data}:
        own = ordered([r for r in data if r[0] == c])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_have_all_preceding_turns_and_only_the_reply(spark):
    data = rows()
    stored = chat.format_conversations(spark.createDataFrame(data, SCHEMA))
    whole = {r.conv_id: r.formatted for r in stored.collect()}
    n = 0
    for r in chat.expand(stored).withColumn("plain", chat.unescape(F.col("target"))).collect():
        own = ordered([x for x in data if x[0] == r.conv_id])
        k = [i for i, x in enumerate(own) if x[2] == "assistant"][r.example]
        assert r.plain == (own[k][3] or "")
        assert r.context.count("<|im_start|>") == k + 1 and r.context.endswith("<|im_start|>assistant\n")
        assert whole[r.conv_id].startswith(r.context + r.target + "<|im_end|>\n")
        n += 1
    assert n == sum(x[2] == "assistant" for x in data)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.digests(chat.format_conversations(df))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_digests_follow_the_spans(spark):
    import pytest

    data = [(1, 0, "user", "ask", None), (1, 1, "assistant", "answer", None), (1, 2, "user", "more", None), (1, 3, "assistant", "reply", None)]
    stored = chat.format_conversations(spark.createDataFrame(data, SCHEMA))
    moved = lambda **by: stored.withColumn("examples", F.transform("examples", lambda e, i: F.struct(e["segment"], *[(e[c] + F.when(i == 1, by.get(c, 0)).otherwise(0)).alias(c) for c in ("context_end", "target_start", "target_end")])))
    loss = lambda df: chat.digests(df).first().loss_sha256
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert loss(moved()) == sha("answerreply")
    assert loss(moved(target_start=1)) == sha("answereply")
    assert loss(moved(target_end=-1)) == sha("answerrepl")
    for by in ({"context_end": 1}, {"context_end": 1, "target_start": 1, "target_end": 1}):
        with pytest.raises(Exception, match="context"):
            loss(moved(**by))


def test_very_long_text_and_many_turns(spark):
    long = "x<|y\\ " * 200_000
    data = [(1, 0, "user", long, None), (1, 1, "assistant", long, None)] + [(2, t, ("user", "assistant")[t % 2], f"t{t}", None) for t in range(2000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(data, SCHEMA))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(long), sha(long))
    assert got[2].loss_sha256 == sha("".join(f"t{t}" for t in range(1, 2000, 2))) and got[2].n_turns == 2000
