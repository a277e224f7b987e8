"""Fill-in-middle transformation of whole documents.

A text is cut into units (code points, words or lines) by a regular expression; the end of every unit goes into an array
of four bytes a unit, so that any cut between units is one lookup. Two cuts and the form come from a digest of the
seed and the document's id alone: reruns, other partitions and other neighbours give the same output. One pass over Arrow batches,
no shuffle; the way back is column expressions only.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, free_name, table

#: What one unit is. Every pattern matches all of any text: no character stands outside a unit.
UNITS = {"code point": r"(?s:.)", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
#: Units to one match.
BLOCK = 256


def compiled(unit: str) -> regex.Pattern:
    """A pattern that takes up to BLOCK units a match, each an own capture of its one group."""
    return regex.compile(f"({UNITS[unit]}){{1,{BLOCK}}}+")


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """The offsets at which the units of ``text`` end, four bytes each; ``pattern`` as ``compiled`` gives it."""
    out = array("I")
    for block in pattern.finditer(text):
        out.extend(block.ends(1))
    return out


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers of 32 bits from the digest of the seed and the id."""
    hexes = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: str, doc_id: str, pattern: regex.Pattern, seed: int, keep_pct: int, spm_pct: int, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(pattern, text)
    n = len(ends)
    a, b, whether, which = draws(seed, doc_id)
    if not n or whether % 100 >= keep_pct or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    i, j = ends[first - 1] if first else 0, ends[second - 1] if second else 0
    p, s, m = marks
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if which % 100 < spm_pct:
        return n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _check(marks: tuple[str, str, str]) -> None:
    """Refuse marks of which one may be seen across the edge of another: with one inside another, or with an end that begins one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("marks must not be empty or overlap")


def fill_in_middle(docs: DataFrame, unit: str = "code point", seed: int = 1, keep_pct: int = 90, spm_pct: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output, output_sha256), one for each row of ``docs``.

    ``n`` counts units. Of texts with units and without a mark, ``keep_pct`` in a hundred are cut, ``spm_pct`` of those with
    the suffix first. A null text is an empty one, and empty ones are plain; a null id draws as the empty id; rows alike
    come out alike; other columns are not read; an empty table gives no rows. Marks must differ and none may end with
    what another begins with, so that the way back is sure.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    _check(marks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = compiled(unit)
        for f in batches:
            rows = []
            for i, t in zip(f["id"], f["text"], strict=True):
                got = transform(t or "", i or "", pattern, seed, keep_pct, spm_pct, marks)
                rows.append((i, *got, hashlib.sha256(got[-1].encode("utf-8", "surrogatepass")).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in FIELDS.split(", ")]])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(as_text(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc_id string, {FIELDS}")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of, by its form and marks alone."""
    o, f = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(after(before(o, s), p), after(o, m), before(after(o, s), m))
    spm = F.concat(before(after(o, p), m), after(o, m), after(before(o, p), s))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)


def fim_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with their texts transformed and ``n_chars``, where there is one, counted anew; all else as it was.

    Rows travel whole beside their text, so that ids may repeat or be missing. A null text comes back empty."""
    row, joined = free_name(docs.columns, "row_"), free_name(docs.columns, "output")
    id_col = options.pop("id_col", "doc_id")
    unit, marks = options.pop("unit", "code point"), options.pop("marks", MARKS)
    seed, keep_pct, spm_pct = (options.pop(k, v) for k, v in (("seed", 1), ("keep_pct", 90), ("spm_pct", 20)))
    if options:
        raise TypeError(f"unknown options {sorted(options)}")
    _check(marks)

    @F.pandas_udf("string")
    def output(ids: pd.Series, texts: pd.Series) -> pd.Series:
        pattern = compiled(unit)
        return pd.Series([transform(t or "", i or "", pattern, seed, keep_pct, spm_pct, marks)[-1] for i, t in zip(ids, texts, strict=True)], dtype=object)

    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), output(as_text(id_col), F.col(text_col).cast("string")).alias(joined))
    new = {text_col: F.col(joined)} | ({"n_chars": F.char_length(joined).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return made.select(*[new.get(c, F.col(row).getField(c)).alias(c) for c in docs.columns])


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut between code points; digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored("output", "form").cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, length(text)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM p
"""
