import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fim

SCHEMA = "doc_id long, text string, output string, form string, n_chars long"


def plain(i, text):
    """The contract, one character at a time."""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    text, n = text or "", len(text or "")
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def rows():
    odd = ["", None, "x", "\n", "a\r\nb\x00c", "é́😀𝒳​", "<", "<P", "<S" * 9, "><M" * 5, "<P>", "in <S> the", "end<M>", "<<P>>", "P>S>M>", "\x85  " * 3]
    out = [(i, t, None, "f", None) for i, t in enumerate(odd * 12)]
    return [*out, (None, "no id", None, None, 3), (None, None, None, None, None), (3, "x", None, None, 1), (3, "x", None, None, 1), (-7, "negative", None, None, 1), (1 << 62, "large", None, None, 1), (5000, "lang 😀 " * 400_000, None, None, 1)]


def test_every_row_against_plain_slicing(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = fim.fill_in_middle(df).withColumn("back", fim.restored("output", "form")).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key)
    assert got == sorted(((i, *plain(i, t)) for i, t, *_ in data), key=key)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert sorted(r.back for r in out) == sorted(t or "" for _, t, *_ in data)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_between_units_and_come_back(spark, unit):
    texts = ["", " lead and  trail ", "one\ntwo\r\n\nthree", "\n\n", "word", "a\x0bb\tc \n"] * 20
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = fim.fill_in_middle(df, unit=unit, seed=9, keep_pct=100, spm_pct=50, marks=marks)
    for r in out.withColumn("back", fim.restored("output", "form", marks)).collect():
        text = texts[r.doc_id]
        assert r.back == text and (r.form == "plain") == (text == "")
        count = len(text.splitlines(keepends=True)) if unit == "line" and "\r" not in text and "\x0b" not in text else None
        assert count is None or r.n == count
        if r.form != "plain":
            edges = {0, *fim.unit_ends(fim.compiled(unit), text)}
            assert r.prefix_chars in edges and r.prefix_chars + r.middle_chars in edges


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = fim.fim_documents(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where(F.char_length("text") != F.col("n_chars")).count() == 0
    want = {r.output_sha256 for r in fim.fill_in_middle(df).collect()}
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in out.collect()} == want


def test_marks_that_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "bc", "<M>"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="page")


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_blocks_of_units_end_where_single_units_end(unit):
    for text in ["", "a", "a  b\n\nc ", " ", "\n", "é😀\n" * 700, "word " * 600 + "\n\n", "x" * 256, "x" * 257, " \t" * 300]:
        assert list(fim.unit_ends(fim.compiled(unit), text)) == [m.end() for m in fim.regex.finditer(fim.UNITS[unit], text)]
