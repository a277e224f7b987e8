"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked when few bits differ.

Candidates: the 64 bits are cut into ``radius + 4`` runs. Fingerprints that differ in at most ``radius`` bits agree on
some ``4`` runs, so each distinct fingerprint is filed under the bits of every choice of 4 runs; the files are shuffled
and sorted by that key. Comparison is bit-sliced: 64 fingerprints that stand together make one word per bit plane, a
row's difference to all 64 of them is one XOR a plane, and carry-save counters (ones, twos, ... and a saturating
overflow) hold 64 distances at once. Words whose 64 counters have all passed the radius are abandoned.

At scale: exact copies meet before any comparison (``groupBy`` fingerprint with a min, combined before the shuffle), a
key holds at most 2^22 distinct fingerprints whatever the corpus, a key's comparison leaves a spanning forest and never
all its pairs, and components are found by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, durable, table
from .components import connected_components


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer; no words or null gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp long), one for each row of ``docs``; whole texts, one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.array([fingerprint(t, shingle, seed) for t in b["text"]], dtype=np.int64)})

    rows = docs.select(as_text(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return as_long(rows.mapInPandas(run, "id string, fp long"), "id")


def _runs(parts: int) -> list[int]:
    """Masks that cut 64 bits into ``parts`` runs."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs (i, j), i < j, of one ``group`` (a sorted key) whose ``fp`` differ in at most ``radius`` bits."""
    n = len(fp)
    if n < 2:
        return np.empty((0, 2), dtype=np.int64)
    words = -(-n // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[:n] = fp
    tiles = padded.reshape(words, 64)
    lanes = np.arange(64, dtype=np.uint64)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    end = last[np.searchsorted(last, np.arange(n))]  # last index of each row's group
    found = []
    rows, step = np.flatnonzero(end > np.arange(n)), 0
    planes = np.empty((64, words), dtype=np.uint64)
    for b in range(64):
        planes[b] = (((tiles >> np.uint64(b)) & np.uint64(1)) << lanes).sum(axis=1, dtype=np.uint64)
    counters = max(1, radius.bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(rows):
        for cut in range(0, len(rows), 1 << 16):
            r = rows[cut : cut + (1 << 16)]
            tile = r // 64 + step
            count, over = [np.zeros(len(r), dtype=np.uint64) for _ in range(counters)], np.zeros(len(r), dtype=np.uint64)
            for b in range(0, 64, 2):  # a full adder takes two planes and the ones; carries go up a counter each
                one = planes[b, tile] ^ (np.uint64(0) - ((fp[r] >> np.uint64(b)) & np.uint64(1)))
                two = planes[b + 1, tile] ^ (np.uint64(0) - ((fp[r] >> np.uint64(b + 1)) & np.uint64(1)))
                half = count[0] ^ one
                carry = (count[0] & one) | (half & two)
                count[0] = half ^ two
                for k in range(1, counters):
                    carry, count[k] = count[k] & carry, count[k] ^ carry
                over |= carry
                if b >= 8 and b % 8 == 0:
                    keep = np.flatnonzero((over | _beyond(count, radius)) != full)
                    if len(keep) < len(r) // 2:  # abandon words in which all 64 distances have passed the radius
                        r, tile, over, count = r[keep], tile[keep], over[keep], [c[keep] for c in count]
                        if not len(r):
                            break
            if not len(r):
                continue
            near = ~(over | _beyond(count, radius))
            hit = np.flatnonzero(near)
            if len(hit):
                w, lane = np.nonzero((near[hit, None] >> lanes) & np.uint64(1))
                i, j = r[hit[w]], tile[hit[w]] * 64 + lane
                ok = (j > i) & (j <= end[i])
                found.append(np.stack([i[ok], j[ok]], axis=1))
        step += 1
        rows = rows[end[rows] // 64 >= rows // 64 + step]
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``: a bit-sliced comparison from the highest counter down."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kept = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def links(distinct: DataFrame, radius: int = 2, fp_col: str = "fp") -> DataFrame:
    """Edges (u, v) over distinct fingerprints: a spanning forest of each key's links, so no link's effect is lost."""
    masks = _runs(radius + 4)
    choices = [_signed(sum(c)) for c in combinations(masks, 4)]
    filed = distinct.select(
        F.col(fp_col).alias("fp"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp_col).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(choices)])).alias("k"),
    )
    rows = filed.select("k.c", "k.bits", "fp").repartition("c", "bits").sortWithinPartitions("c", "bits", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def compare(a: np.ndarray) -> pd.DataFrame:
            new = np.append(False, (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1]))
            group = np.cumsum(new)
            size = np.bincount(group, minlength=1)
            a, group = a[size[group] > 1], group[size[group] > 1]  # alone under its key: nothing to compare
            fp = np.ascontiguousarray(a[:, 2])
            kept = _forest(within_radius(fp.view(np.uint64), group, radius))
            ij = np.array(kept, dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"u": fp[ij[:, 0]], "v": fp[ij[:, 1]]})

        for b in batches:
            a = b[["c", "bits", "fp"]].to_numpy(dtype=np.int64)
            if not len(a):
                continue
            cut = np.flatnonzero((a[:, 0] != a[-1, 0]) | (a[:, 1] != a[-1, 1]))
            cut = cut[-1] + 1 if len(cut) else 0  # the last key may go on in the next batch
            if cut:
                yield compare(np.concatenate([*held, a[:cut]]))
                held = []
            held.append(a[cut:])
        if held:
            yield compare(np.concatenate(held))

    return rows.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    component_id is the smallest id that is reachable over links of at most ``radius`` differing bits, itself included.
    Null and empty texts have fingerprint zero and link like any other; repeated rows come back repeated; a null id
    takes part but is never a component's id unless all its ids are null; other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    fps = durable(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = durable(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = connected_components(links(distinct, radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
