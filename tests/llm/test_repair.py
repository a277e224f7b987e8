import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, digest string, later boolean"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def best(rows):
    """(cost, audit, turns) by plain search: rows are (role, text, fault)."""

    @functools.cache
    def go(i, q, run):
        out = []
        if i == len(rows) and q in (0, 3):
            out.append((0, "", ()))
        if run < 4:
            for role in ("user", "assistant"):
                if (q, role[0]) in MOVES and (tail := go(i, MOVES[q, role[0]], run + 1)):
                    out.append((tail[0] + 3, "I" + tail[1], ((role, ""), *tail[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            if tail := go(i + 1, q, 0):
                out.append((tail[0] + 4, "D" + tail[1], tail[2]))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (q, role[:1]) in MOVES and (tail := go(i + 1, MOVES[q, role[:1]], 0)):
                    out.append((tail[0] + more, "K" + tail[1], ((role, text), *tail[2])))
                for new in ("user", "assistant"):
                    if (q, new[0]) in MOVES and (tail := go(i + 1, MOVES[q, new[0]], 0)):
                        out.append((tail[0] + 3 + more, "R" + tail[1], ((new, text), *tail[2])))
        return min(out, default=None)

    return go(0, 0, 0)


def report(rows):
    """The contract of one conversation's rows (turn, role, text), by plain loops."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, out = best(tuple(marked))
    n = lambda f: sum(m[2] == f for m in marked)
    return gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out


def conversations(seed=1, count=300):
    rnd = random.Random(seed)
    rows = []
    for c in range(count):
        said = [rnd.choice(["Yes.", "No!", "cut", "", " \t\x0b", "why?", "é\x85", "Yes. \n", f"text {rnd.random()}."]) for _ in range(rnd.randint(1, 9))]
        for k, text in enumerate(said):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.5 else ("user", "assistant")[k % 2] if rnd.random() < 0.8 else rnd.choice(["system", "tool", "", None, "sys", "User"])
            rows.append((c, None if rnd.random() < 0.05 else k + (rnd.random() < 0.1) * 3, role, None if rnd.random() < 0.05 else text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Oh."), (None, None, None, None), (-5, 3, "user", "long " * 900_000 + "."), (-5, 4, "assistant", "short."), (1 << 62, (1 << 62) + 1, "user", "Far."), (1 << 62, 1 << 62, "user", "Far.")]
    return [(*r, None, None) for r in rows]


def grouped(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        out[c].append((t, r, x))
    return out


def test_reports_and_turns_against_plain_search(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {c: report(g) for c, g in grouped(rows).items()}
    got = repair.repair_report(df.repartition(5)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id][:8], r.conv_id
    turns = defaultdict(list)
    for r in repair.repaired_turns(df).orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.turn, r.edit, r.role, r.text))
    for c, w in want.items():
        assert [t[2:] for t in turns[c]] == list(w[8]) and [t[0] for t in turns[c]] == list(range(len(w[8])))
        assert "".join(t[1] for t in turns[c]) == w[6].replace("D", "")
    assert repair.repair_report(df.limit(0)).count() == 0


def test_damage_by_plain_loops(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Say {c} {t}. Ok?! {'x' * (t == 3)}") for c in range(150) for t in range(5)] + [(9_000, 0, None, None), (None, None, "user", "A.")]
    gone = next(c for c in range(10_000, 20_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows.append((gone, 0, "user", "All gone."))
    after = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        after[c] += [] if harm == 0 else [(t, r, "")] if harm == 1 else [(t, r, "".join(k for k in x if k not in ".!?"))] if harm == 2 else [(t, r, x)] * 2 if harm == 3 else [(t, "user", x)] if harm == 4 else [(t, r, x)]
    got = repair.repair_report(repair.damaged(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))).collect()
    assert {r.conv_id for r in got} == {c for c, *_ in rows} and len(got) == len(after)
    for r in got:
        assert tuple(r)[1:] == report(after[r.conv_id])[:8]
    none = next(r for r in got if r.conv_id == gone)
    assert tuple(none)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("stretch", [1, 2, 5, 64])
def test_stretches_give_what_one_piece_gives(monkeypatch, stretch):
    rnd = random.Random(stretch)
    for _ in range(150):
        codes = bytes(rnd.choice([0, 1, 2, 3, 1, 2, 1, 2, 5, 6, 9, 10, 4]) for _ in range(rnd.randint(0, 24)))
        rows = tuple(("sua?"[c & 3], "t", "blank" if c & 8 else "truncated" if c & 4 else "") for c in codes)
        monkeypatch.setattr(repair, "STRETCH", stretch)
        cost, audit = repair.cheapest(codes)
        assert (cost, audit.decode()) == best(rows)[:2], codes


def test_a_long_conversation_goes_through_its_scratch_file(spark, monkeypatch):
    n = 6000
    monkeypatch.setattr(repair, "HELD", 5000)
    rows = [(1, k, ("user", "assistant")[k % 2] if k % 11 else "user", f"Turn {k}." if k % 17 else "Same.", None, None) for k in range(n)]
    r = repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    c = repair.Conversation("1")
    for _, t, role, text, *_ in rows:
        c.add(t, role, text, text.encode() + role.encode(), text == "Same." and t not in (0, 17))
    assert r.cost == c.repaired()[0] and len(r.audit.replace("I", "")) == n
    assert r.duplicate == len([k for k in range(0, n, 17)]) - 2
    out = [f"{x[1]}:{x[2]}" for x in c.repaired()[2]]
    assert hashlib.sha256("\n".join(out).encode()).hexdigest() == r.repaired_sha256
    roles = [x.split(":")[0] for x in out]
    assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert spark.createDataFrame(rows, SCHEMA).where(F.col("text") == "Same.").count() == r.duplicate + 2
