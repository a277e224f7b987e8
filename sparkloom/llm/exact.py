"""Exact deduplication against a history kept as minimal perfect hash tables.

Distinct digests of what was seen are dealt by their leading bits into parts of bounded size. A part's table is a minimal
perfect hash: at each level every digest left hashes to one bit, those alone on their bit stay, the others go on to the
next level; the rank of a digest's bit among all set bits is its slot. Slots hold the whole digest, the winner's id and row
and the number of copies. A lookup costs one bit a level, and whatever slot comes out counts only if its 32 bytes are the
digest's own; digests that are in no slot are grouped among themselves.

Copies meet in a combined aggregate before anything else, so a part holds each digest once, however many rows share it, and
digests are uniform, so parts are even. Texts are read once; what goes on is a digest and a number a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, fold, table

#: Distinct digests to a part, on average, and levels of bits before what is left is searched in order.
PER_PART, LEVELS = 8192, 40
#: Bits a digest at each level.
ROOM = 2
SLOTS = "digest binary, winner_id long, winner_row long, copies long"
INDEX = "parts long, part long, widths array<long>, bits binary, digests binary, winner_id array<long>, winner_row array<long>, copies array<long>"
FOUND = "digest binary, old_id long, old_row long, old_copies long, new_id long, new_row long, new_copies long"


def _bit(lanes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bit of each digest (four 64-bit lanes) at a level: all lanes, mixed by multiplying and shifting."""
    x = np.full(len(lanes), level * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, np.uint64)
    for k in range(4):
        x = (x ^ lanes[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(width)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: ``slots`` gives numbers below their count, -1 where it is certain that a digest is none of them."""

    def __init__(self, widths: list[int], bits: bytes, rest: np.ndarray):
        self.widths, self.bits, self.rest = widths, bits, rest
        packed, at, base = np.frombuffer(bits, np.uint8), 0, 0
        self.levels = []
        for w in widths:
            level = np.unpackbits(packed[at : at + (w + 7) // 8], count=w)
            rank = np.cumsum(level, dtype=np.int64) - level + base
            self.levels.append((level, rank))
            at, base = at + (w + 7) // 8, base + int(level.sum())
        self.placed = base

    @classmethod
    def build(cls, digests: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the order in which ``digests`` (n x 32 bytes, distinct) fill its slots."""
        lanes, left = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4), np.arange(len(digests))
        widths, bits, order = [], [], []
        while len(left) and len(widths) < LEVELS:
            w = max(8, ROOM * len(left))
            at = _bit(lanes[left], len(widths), w)
            alone = np.bincount(at, minlength=w) == 1
            stays = alone[at]
            order.append(left[stays][np.argsort(at[stays], kind="stable")])
            widths.append(w)
            bits.append(np.packbits(alone).tobytes())
            left = left[~stays]
        order.append(left)
        return cls(widths, b"".join(bits), digests[left]), np.concatenate(order)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest that is in the table; any slot, or -1, for others."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        lanes = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        for k, (level, rank) in enumerate(self.levels):
            at = _bit(lanes[left], k, self.widths[k])
            hit = level[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            number = {d.tobytes(): self.placed + i for i, d in enumerate(self.rest)}
            out[left] = [number.get(digests[i].tobytes(), -1) for i in left]
        return out


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(doc_id, row, digest) and the columns ``more`` of every row: SHA-256 of the text's UTF-8 with A-Z lower-cased; null counts as empty.

    ``row`` tells rows of one id apart; write the result before ``row`` is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("digest"))
            made = pa.array([hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([made if f.name == "digest" else b.column(i) for i, f in enumerate(b.schema)], b.schema.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").cast("binary").alias("digest"), *[c.alias(n) for n, c in more.items()])
    return rows.mapInArrow(run, rows.schema)


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, winner_id, winner_row, copies): equal digests as one row; the largest id wins, of equal ids the largest row, null ids last."""
    g = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count(F.lit(1)).alias("copies"))
    return g.select("digest", F.col("w.doc_id").alias("winner_id"), F.col("w.row").alias("winner_row"), "copies")


def parts_for(rows: int) -> int:
    """How many parts so many digests are dealt to."""
    return max(1, -(-rows // PER_PART))


def _part(parts: int) -> Column:
    """A digest's part, by its leading 32 bits."""
    return F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * F.lit(parts) / F.lit(float(1 << 32))).cast("long")


def index(groups: DataFrame, parts: int) -> DataFrame:
    """One row a part, with the perfect hash of its digests and what their slots hold. ``groups`` as ``grouped`` gives them; write it where it is to be used again."""

    def run(t: pa.Table) -> pa.Table:
        digests = _bytes(t["digest"])
        made, order = PerfectHash.build(digests)
        of = t.take(pa.array(order))
        lists = {c: pa.array([of[c].to_pylist()], pa.list_(pa.int64())) for c in ("winner_id", "winner_row", "copies")}
        head = {"parts": pa.array([parts], pa.int64()), "part": t["part"][:1], "widths": pa.array([made.widths], pa.list_(pa.int64())), "bits": pa.array([made.bits], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary())}
        return pa.table(head | lists)

    return groups.select(_part(parts).alias("part"), *[c.split()[0] for c in SLOTS.split(", ")]).groupBy("part").applyInArrow(run, INDEX)


def slots(indexed: DataFrame) -> DataFrame:
    """What an index holds, a row a digest."""
    each = F.explode(F.arrays_zip("winner_id", "winner_row", "copies", F.sequence(F.lit(0), F.size("copies") - 1).alias("at"))).alias("s")
    return indexed.select("digests", each).select(F.expr("substring(digests, s.at * 32 + 1, 32)").alias("digest"), "s.winner_id", "s.winner_row", "s.copies")


def matched(indexed: DataFrame, fresh: DataFrame, parts: int) -> DataFrame:
    """(digest, old_id, old_row, old_copies, new_id, new_row, new_copies): every digest of the index or of ``fresh``, once.

    ``fresh`` holds distinct digests, as ``grouped`` gives them. Old is null for digests that no slot holds byte for byte."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        n, asked = 0, _bytes(new["digest"])
        at, held = np.full(len(asked), -1, np.int64), np.zeros((0, 32), np.uint8)
        if old.num_rows:
            row = {c: old[c][0] for c in old.column_names}
            held = np.frombuffer(row["digests"].as_py(), np.uint8).reshape(-1, 32)
            n, widths = len(held), row["widths"].as_py()
            made = PerfectHash(widths, row["bits"].as_py(), held[:0])
            made.rest = held[made.placed :]
            at = made.slots(asked)
            at[at >= 0] = np.where((held[at[at >= 0]] == asked[at >= 0]).all(axis=1), at[at >= 0], -1)
        member = at >= 0
        back = np.full(n, -1, np.int64)
        back[at[member]] = np.flatnonzero(member)
        of_new = np.concatenate([back, np.flatnonzero(~member)])
        pick = pa.array(of_new, mask=of_new < 0)
        out = {"digest": pa.array([*map(bytes, held), *[d.tobytes() for d in asked[~member]]], pa.binary())}
        for short, name in (("id", "winner_id"), ("row", "winner_row"), ("copies", "copies")):
            values = pa.concat_arrays([row[name].values, pa.nulls(len(of_new) - n, pa.int64())]) if n else pa.nulls(len(of_new), pa.int64())
            out |= {f"old_{short}": values, f"new_{short}": new[name].take(pick)}
        return pa.table(out).select([c.split()[0] for c in FOUND.split(", ")])

    left = indexed.select(*[c.split()[0] for c in INDEX.split(", ")]).groupBy("part")
    right = fresh.select(_part(parts).alias("part"), *[c.split()[0] for c in SLOTS.split(", ")]).groupBy("part")
    return left.cogroup(right).applyInArrow(run, FOUND)


def merged(found: DataFrame) -> DataFrame:
    """(digest, winner_id, winner_row, copies, seen): old and new copies together; ``seen`` where the history held the digest. The groups of the next index."""
    old = F.when(F.col("old_copies").isNotNull(), F.struct(F.col("old_id").alias("id"), F.col("old_row").alias("row")))
    new = F.when(F.col("new_copies").isNotNull(), F.struct(F.col("new_id").alias("id"), F.col("new_row").alias("row")))
    w = found.withColumn("w", F.greatest(old, new))
    copies = F.coalesce("old_copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))
    return w.select("digest", F.col("w.id").alias("winner_id"), F.col("w.row").alias("winner_row"), copies.alias("copies"), F.col("old_copies").isNotNull().alias("seen"))


def against(indexed: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``merged`` groups of an index and ``total`` new rows (as ``digested`` gives them). An index whose parts are too few for so many is dealt anew first."""
    at = indexed.select("parts").first()
    parts = at[0] if at else parts_for(total)
    if at and total > 8 * PER_PART * parts:
        parts = parts_for(total)
        indexed = durable(index(slots(indexed), parts), "exact-index")
    return merged(matched(indexed, grouped(rows), parts))


def deduplicate(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256, seen), one for each row of ``docs``, dropped ones too.

    Rows where ``history`` holds are indexed first; the others are looked up, and their groups take over where their ids
    are larger. Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest
    doc_id stays; of rows that share that id too, just one; a row without an id stays only where no copy has one. ``seen``
    tells whether the history held the text. No other column is read; an empty table gives no rows.
    """
    rows = durable(digested(docs, id_col, text_col, old=F.coalesce(history, F.lit(False))), "digests")
    total = rows.count()
    parts = parts_for(total)
    indexed = durable(index(grouped(rows.where("old")), parts), "exact-index")
    groups = durable(merged(matched(indexed, grouped(rows.where("not old")), parts)).withColumnRenamed("digest", "digest_"), "exact-groups")
    discard(indexed)
    out = rows.join(groups, F.col("digest") == F.col("digest_"))
    return out.select("doc_id", F.col("winner_id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("row") == F.col("winner_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "seen")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose id has an even crc32 are the history that the others are looked up in."""
    return deduplicate(table(spark, sf_dir, "documents"), fold("doc_id", 2) == 0).drop("seen")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
