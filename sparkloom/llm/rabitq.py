"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector x, less the centre c, is rotated and kept as one bit a dimension plus two scalars: its length and the
code's product with the vector it stands for. From packed bits and scalars
alone the inner product with a query is estimated without bias, and the scalars bound the error. A block of vectors is
searched for a block of queries by estimates; only vectors whose upper bound reaches the best exact scores are reranked
on the original vectors, in double precision.

The query set is a stated twentieth of the rows, so the work is query blocks against row blocks: rows and queries are
dealt to blocks by a hash (copies and clusters spread evenly), each block pair is one task of bounded memory, and a pair
gives ``k`` rows a query. The final ranking sees (row blocks x k) rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, table

#: Rows in a block: a thirty-second of the index within these bounds, and queries in a block. A pair of the largest blocks
#: takes about 400 MB at 64 dimensions.
ROW_BLOCKS, LEAST_ROWS, MOST_ROWS, QUERY_BLOCK = 32, 1 << 12, 1 << 17, 1 << 16
#: Width of the error bound in standard errors: a true neighbour is passed over with a chance below 1 in 100, near the k-th only.
EPSILON = 2.5


def usable(vec: Column) -> Column:
    """Not null, not zero, every component finite."""
    v = vec.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _sizes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` scaled to length 1 (zero rows stay), and their lengths; squares never overflow."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    most = np.where((most > 0) & np.isfinite(most), most, 1)
    y = x / most
    size = np.sqrt((y * y).sum(axis=1))
    return y / np.where(size > 0, size, 1)[:, None], size * most[:, 0]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated rows of ``x``, their distance to the centre, and the correction."""
    with np.errstate(over="ignore", invalid="ignore"):
        unit, length = _sizes(x - centre)
        y = unit @ turn
    bits = np.packbits(y > 0, axis=1)
    fit = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])  # <code, vector>, about 0.8
    return bits, length, np.where(length > 0, fit, 1.0)


def exact(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``q``, summed component by component, so that copies get equal scores."""
    return np.cumsum(a.astype(np.float64) * q.astype(np.float64), axis=1)[:, -1]


def search_block(
    ids: np.ndarray, x: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray],
    query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query the ``k`` nearest ids of the block, each by its best row, by (score down, id up): query ids, ids, scores,
    rows reranked.

    Estimates are in units of the block's longest row times the query's length, so that single precision serves any scale;
    a row whose length is not finite is always reranked. Reranking takes the products of all chosen rows at once and sums
    those near the k-th best anew, component by component.
    """
    bits, length, fit = codes
    d = x.shape[1]
    with np.errstate(all="ignore"):
        turned, size = _sizes(queries.astype(np.float64))
        along = turned @ centre
        turned = (turned @ turn).astype(np.float32)
        odd = ~np.isfinite(length) | ~np.isfinite(fit) | (fit <= 0)
        unit = float(length[~odd].max(initial=0)) or 1.0
        far = np.where(odd, 0, length / unit)
        gain = np.where(odd, 0, far / (np.where(odd, 1, fit) * np.sqrt(d))).astype(np.float32)
        spread = np.where(odd, np.inf, far * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * (epsilon / np.sqrt(max(1, d - 1))) + 1e-4 * far + 1e-5).astype(np.float32)
        signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        slack = 1e-9 * float(np.abs(x).max(initial=0)) * d
    repeats = len(np.unique(ids)) < len(ids)
    place = {} if repeats else dict(zip(ids.tolist(), range(len(ids)), strict=True))
    out_q, out_i, out_s, reranked = [], [], [], 0
    for at in range(0, len(queries), 128):
        part = slice(at, at + 128)
        # <x, q> = <c, q> + <x - c, q>: the centre's part is the same for every row
        estimate = (turned[part] @ signs.T) * gain
        for j, e in enumerate(estimate):
            q = at + j
            own = np.flatnonzero(ids == query_ids[q]) if repeats else np.array([p for p in [place.get(int(query_ids[q]))] if p is not None], dtype=np.int64)
            e[own] = -np.inf
            others, width = len(ids) - len(own), 2 * k
            with np.errstate(all="ignore"):
                while True:  # once, but where ids repeat so often that the best rows are of fewer than k of them
                    first = np.argpartition(-e, width)[:width] if len(ids) > width else np.arange(len(ids))
                    first = first[e[first] > -np.inf]
                    sure = exact(x[first], queries[q]) if len(first) else np.empty(0)
                    sure = sure[_best(ids[first], sure, k, repeats)]
                    if len(sure) >= k or len(first) >= others or not len(first):
                        break
                    width *= 4
                if not len(first):
                    continue
                chosen = first
                if len(first) < others:
                    floor = (float(sure[-1]) / size[q] - along[q]) / unit if len(sure) >= k else -np.inf
                    chosen = np.flatnonzero(e + spread >= (floor - 1e-6 * abs(floor) if np.isfinite(floor) else -np.inf))
                    chosen = chosen[e[chosen] > -np.inf]
                reranked += len(chosen)
                if len(chosen) > 4 * k and not repeats:
                    near = x[chosen] @ queries[q]
                    chosen = chosen[~(near < np.partition(near, len(near) - k)[len(near) - k] - slack * size[q])]
                scores = exact(x[chosen], queries[q])
            best = _best(ids[chosen], scores, k, repeats)
            out_q.append(np.full(len(best), query_ids[q]))
            out_i.append(ids[chosen[best]])
            out_s.append(scores[best])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s), reranked


def _best(ids: np.ndarray, scores: np.ndarray, k: int, repeats: bool) -> np.ndarray:
    """Places of the ``k`` best ids by (score down, id up), each at its best row."""
    order = np.lexsort((ids, -scores))
    if repeats:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


INDEX = "id long, dim int, vec array<double>, code binary, length double, fit double"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 20_000, seed: int = 0) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Rows (id, dim, vec, code, length, fit) for every usable vector, and a centre for each dimension.

    Centres come from about ``sample`` rows chosen by a hash of the id; they affect bounds, never which rows are indexed.
    Vectors are kept in double precision. Rows of an id that repeats are all indexed; other columns are not read; an empty
    table gives no rows.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))
    sizes = {r.dim: r.n for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a dimension
    rows = sum(sizes.values())
    some = good.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, rows // sample))) == 0)
    mean = some.select("dim", F.posexplode("vec")).groupBy("dim", "pos").agg(F.avg("col").alias("m")).collect()  # dimensions squared at most
    centres = {d: np.zeros(d) for d in sizes}
    for r in mean:
        centres[r.dim][r.pos] = r.m if np.isfinite(r.m) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for f in batches:
            dims = f.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                g = f.filter(pa.array(dims == d))
                bits, length, fit = encode(matrix(g.column("vec"), d), centres[d], turns.setdefault(d, rotation(d, seed)))
                yield pa.RecordBatch.from_arrays([g.column("id"), g.column("dim"), g.column("vec"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(fit)], ["id", "dim", "vec", "code", "length", "fit"])

    return good.select("id", "dim", "vec").mapInArrow(run, INDEX), centres


def search(index: DataFrame, centres: dict[int, np.ndarray], queries: Column, k: int = 20, row_block: int | None = None, query_block: int = QUERY_BLOCK, seed: int = 0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of ``index`` that ``queries`` (a condition on id) selects, its
    ``k`` nearest other rows of its dimension by inner product, ties to the smaller id.

    Rows with the query's own id are never its neighbours; an id that repeats is one query and its copies one neighbour
    (the best). An empty index or no queries give no rows; fewer candidates than ``k`` give as many as there are.
    """
    n, m = index.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    row_block = row_block or min(MOST_ROWS, max(LEAST_ROWS, -(-n // ROW_BLOCKS)))
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    rows = index.withColumn("rb", F.pmod(F.xxhash64("id", "vec"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = index.where(queries).groupBy("id", "dim").agg(F.min("vec").alias("vec"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def pair(a: pa.Table, q: pa.Table) -> pa.Table:
        got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if len(a) and len(q):
            d = a["dim"][0].as_py()
            codes = (np.frombuffer(b"".join(a["code"].to_pylist()), np.uint8).reshape(len(a), -1), a["length"].to_numpy(), a["fit"].to_numpy())
            got = search_block(a["id"].to_numpy(), matrix(a["vec"], d), codes, q["id"].to_numpy(), matrix(q["vec"], d), centres[d], rotation(d, seed), k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    found = rows.groupBy("dim", "rb", "qb").cogroup(asked.groupBy("dim", "rb", "qb")).applyInArrow(pair, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # rows of one id may lie in several blocks
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index all usable vectors and search for those whose id ``every`` divides.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id; see
    ``search`` for ids that repeat, ties and empty tables; other columns are not read.
    """
    index, centres = build_index(vectors, id_col, vec_col)
    return search(durable(index, "rabitq"), centres, F.col("id") % every == 0, k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
