import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkloom import cli
from sparkloom.plans import corpus
from sparkloom.sources import files, replay, reports
from sparkloom.streaming.weekly import deduplicated, run_available, weekly_counts


def test_files_round_trips_and_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", line\nbreak'), (2, None)], "id int, text string")
    for kind in ("csv", "parquet", "jsonl", "orc"):
        at = str(tmp_path / f"t.{kind}")
        files.write(df, at)
        got = files.read(spark, at, schema="id int, text string")
        assert sorted((r.id, r.text) for r in got.collect()) == [(1, 'a "quoted", line\nbreak'), (2, None)]
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            files.write(df, at)
    with pytest.raises(ValueError):
        files.read(spark, "x.xlsx")
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "t.csv")]).endswith("t.csv")


def test_encodings_and_separators(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("id;text\n1;café\n".encode("latin-1"))
    assert [r.text for r in files.read_encoded_csv(spark, str(p), ["id", "text"]).collect()] == ["café"]


def test_schema_padding_and_candidates(spark):
    df = spark.createDataFrame([("7", "t", 0.1)], "id string, Body string, sentiment double")
    s = StructType([StructField("id", IntegerType()), StructField("username", StringType()), StructField("sentiment", StringType())])
    assert files.to_schema(df, s, drop=("sentiment",)).first().asDict() == {"id": 7, "username": None, "sentiment": None}
    assert files.first_column(df, ["text", "body"]) == "Body" and files.first_column(df, ["x"]) is None


def test_consolidate_and_resume(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i), (10 + i, i)], "id int, likes int").write.parquet(str(tmp_path / f"raw_{i}.parquet"))
    got = files.consolidate(spark, str(tmp_path / "raw_*.parquet"), ["id"], "likes")
    assert sorted((r.id, r.likes) for r in got.collect()) == [(1, 2), (10, 0), (11, 1), (12, 2)]
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    at = str(tmp_path / "job")
    assert files.resumable(spark, at, build, cap=5)[1] == {"path": at, "rows": 5, "built": True, "cap_hit": True}
    assert files.resumable(spark, at, build)[1]["built"] is False and len(calls) == 1


def test_hash_gate_and_cli(spark, tmp_path, capsys):
    p = tmp_path / "in.txt"
    p.write_text("hello")
    good = hashlib.sha256(b"hello").hexdigest()
    assert files.hash_problems(spark, {str(p): good}).count() == 0
    bad = {str(p): "0" * 64, str(tmp_path / "gone"): good}
    assert sorted(r.problem for r in files.hash_problems(spark, bad).collect()) == ["changed", "missing"]
    (tmp_path / "frozen.json").write_text(json.dumps(bad))
    assert cli.main(["--check-inputs", str(tmp_path / "frozen.json")]) == 1
    assert cli.main(["--list"]) == 0 and "flagship_weekly_share" in capsys.readouterr().out
    assert cli.main(["--query", "flagship_weekly_share"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["--list", "--query", "x"])


def test_config_and_manifest(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"rent": {"topics": ["1", "2"]}, "buy": {"topics": []}}))
    assert sorted((r.name, r.topic) for r in files.config_rows(spark, str(tmp_path / "c.json"), "topics", "topic").collect()) == [("rent", "1"), ("rent", "2")]
    m = files.query_manifest(spark.createDataFrame([("s", "a OR b")], "stream string, subquery string"), spark.createDataFrame([("2024-01-01", "2024-01-08")], "start string, stop string"), 20)
    assert m.first().query_length == len(m.first().query) and not m.first().fits


def test_paged_replay(spark, tmp_path):
    items = [{"id": i, "created_utc": 1000 + i // 2, "body": f"b{i}"} for i in range(25)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, items)))
    replay.register(spark)
    got = spark.read.format("paged_replay").option("path", str(tmp_path)).option("limit", "5").option("after", "1002").load().collect()
    assert sorted(int(r.id) for r in got) == list(range(4, 25)) and len(got) == 21
    assert max(r.page for r in got) >= 3


def test_reports(spark):
    df = spark.createDataFrame([("a_b & c", 0.12345), (None, None)], "name string, v double")
    assert r"a\_b \& c & 0.123 \\" in reports.latex(df) and "| a_b & c | 0.123 |" in reports.markdown(df)
    text = reports.review_packet(df.limit(1), "T", "name", {"Target": "name"}, ["relevant"])
    assert "> a_b & c" in text and "- relevant: " in text


def test_weekly_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    e.repartition(3).write.parquet(src)
    stream = deduplicated(spark.readStream.schema(e.schema).parquet(src), "event_id", "ts", "60 days")
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == e.count()
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    late = weekly_counts(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src), "ts", ["event_type"], F.col("value") > 50, "60 days")
    q = late.writeStream.outputMode("complete").format("memory").queryName("weekly_out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("weekly_out").collect()))
    assert got == sorted(map(tuple, weekly_counts(e, "ts", ["event_type"], F.col("value") > 50).collect()))
    assert all(r[0].weekday() == 0 for r in got)


def test_corpus_plan(spark):
    ts = "2026-02-0{} 10:00:00"
    rows = [
        ("1", "reddit", "reddit_post", "My landlord raised the rent", "ann", ts.format(1), "1", "", True),
        ("2", "reddit", "reddit_comment", "that is a lot", "bob", ts.format(2), "1", "t3_1", True),
        ("3", "reddit", "reddit_comment", "That is  a lot", "bob", ts.format(3), "1", "t3_1", True),
        ("4", "reddit", "reddit_comment", "I moderate the rent", "u/AutoModerator", ts.format(3), "1", "t1_2", True),
        ("5", "reddit", "reddit_comment", "[deleted]", "x", ts.format(3), "1", "t1_2", True),
        ("6", "x", "x_post", "#Villa for sale whatsapp me https://a.b", "ad", ts.format(3), "", "", True),
        ("7", "x", "x_post", "villa in french", "c", ts.format(3), "", "", False),
        ("8", "x", "x_post", "nothing here", "c", ts.format(3), "", "", True),
        ("9", "x", "x_post", "old villa", "c", "2025-12-31 23:59:59", "", "", True),
        ("10", "x", "x_post", "the villa market", None, "2026-02-08 21:00:00", "", "", True),
    ]
    d = spark.createDataFrame(rows, corpus.FIELDS.replace("timestamp_utc timestamp", "timestamp_utc string")).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    good, flow = corpus.build(d, "2026-01-01", "2026-05-01")
    got = {r.id: r for r in good.collect()}
    assert set(got) == {"1", "2", "3", "10"}
    assert got["2"].context_text == got["2"].parent_text == "My landlord raised the rent"
    assert got["3"].author_repeat and not got["2"].author_repeat and got["2"].training_representative and not got["3"].training_representative
    assert str(got["10"].week) == "2026-02-09"  # already Monday in the local zone
    assert got["10"].author_key == "record:x:x_post:10"
    removed = {(r.stage, r.post_type): r.removed for r in flow.collect() if r.removed}
    assert removed == {
        ("invalid_or_outside_utc_capture_window", "x_post"): 1, ("empty_or_deleted_target", "reddit_comment"): 1, ("x_non_english_metadata", "x_post"): 1,
        ("known_reddit_automoderator", "reddit_comment"): 1, ("no_property_evidence", "x_post"): 1, ("target_solicitation", "x_post"): 1,
    }
    with pytest.raises(Exception, match="Duplicate"):
        corpus.build(d.union(d), "2026-01-01", "2026-05-01")


def test_verify_mode(spark, sf_dir, tmp_path, capsys):
    from sparkloom import cli
    from sparkloom.plans.catalog import QUERIES

    at = str(tmp_path / "stored")
    QUERIES["value_counts"](spark, sf_dir).write.parquet(at)
    assert cli.main(["--verify", "value_counts", "--data", sf_dir, "--stored", at]) == 0
    spoiled = str(tmp_path / "spoiled")
    spark.read.parquet(at).limit(2).write.parquet(spoiled)
    assert cli.main(["--verify", "value_counts", "--data", sf_dir, "--stored", spoiled]) == 1
    assert cli.main(["--verify", "value_counts"]) == 2


def test_entry_survives_a_missing_package(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *a, **k):
        if name.split(".")[0] == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")
        return real(name, *a, **k)

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="tokenizers"):
        names = entry.queries()
    assert "flagship_weekly_share" in names and not any(n.startswith("op1_") for n in names)
