"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are computed once for every whole text and kept as a small table. The features cos(Wx + b) approximate a
Gaussian kernel over the standardized statistics; each partition sums its own normal equations and only those sums
(a fixed number of doubles, whatever the rows) reach the driver. Calibration is isotonic over a fixed grid of raw
scores whose counts are a plain aggregate over all rows of the calibration fold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, durable, fold, free_name, table

FEATURES = 512
GRID = 1024
HELD_OUT, CALIBRATION, MODULUS = 0, 4, 5
#: Labelled rows for each of the sums that meet at a level of the tree.
ROWS_A_SUM = 2_000_000

_CLASSES = np.full(256, 6, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 mark, 6 beyond ASCII or control
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[10] = 4
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASSES[_c] = 5
_SENTENCE = re.compile(rb"[.!?]+(?=[\s]|$)")
N_STATS = 30


def statistics(text: str | None) -> np.ndarray:
    """Thirty figures of a whole text, all defined for null and empty texts (zeros)."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    out = np.zeros(N_STATS)
    if not b:
        return out
    raw = np.frombuffer(b, np.uint8)
    kinds = np.bincount(_CLASSES[raw], minlength=7).astype(float)
    n = float(len(b))
    words = b.split()
    nw = float(len(words))
    out[0], out[1] = np.log1p(n), np.log1p(nw)
    out[2:9] = kinds / n
    if not words:
        return out
    lens = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    out[9], out[10], out[11] = min(lens.mean(), 40), min(lens.std(), 40), np.log1p(lens.max())
    seen = Counter(words)
    top = seen.most_common(4)
    out[12], out[13] = len(seen) / nw, top[0][1] / nw
    out[14] = sum(c for _, c in top) / nw
    p = np.fromiter(seen.values(), dtype=float, count=len(seen)) / nw
    out[15] = float(-(p * np.log(p)).sum()) / np.log(nw + 1)
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    nt = max(1.0, nw - 2)
    out[16] = len(tri) / nt
    out[17] = np.log1p(max(tri.values(), default=0))
    out[18] = sum(c for c in tri.values() if c > 1) / nt
    ends = Counter(w[-1:] for w in words)
    out[19] = sum(c for e, c in ends.items() if e in b"!?#$%&*|~^=+<>@") / nw
    out[20] = max((c for e, c in ends.items() if not e.isalnum()), default=0) / nw
    out[21] = sum(1 for w in seen if not any(map(w.count, (b"a", b"e", b"i", b"o", b"u")))) / len(seen)
    lines = [x for x in b.split(b"\n") if x.strip()]
    nl = float(len(lines)) or 1.0
    sizes = Counter(lines)
    out[22], out[23] = len(sizes) / nl, sum(len(k) * (c - 1) for k, c in sizes.items()) / n
    out[24], out[25] = np.log1p(nl), np.log1p(n / nl)
    sentences = len(_SENTENCE.findall(b))
    out[26] = np.log1p(nw / (sentences + 1))
    out[27] = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / nw
    out[28] = len(zlib.compress(b, 1)) / n
    out[29] = np.log1p(b.count(b"http") + b.count(b"@"))
    return out


@dataclass
class Model:
    """Standardization, random features, ridge weights and the calibration's steps; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        out = np.empty((len(x), self.w.shape[1] + 1))
        out[:, 0] = 1.0
        np.cos(z @ self.w + self.b, out=out[:, 1:])
        out[:, 1:] *= np.sqrt(2.0 / self.w.shape[1])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.beta is None else self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _grid(raw: np.ndarray) -> np.ndarray:
    """Cell of a raw score; ridge scores of 0/1 labels live near [0, 1]."""
    return np.clip(np.floor((raw + 0.5) * GRID / 2.0), 0, GRID - 1).astype(np.int64)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells in order: mean position and value of each pool, values rising."""
    pools: list[list[float]] = []
    for xi, yi, ni in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        pools.append([xi * ni, yi, ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x array<float>), one for each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"doc_id": f["id"], "x": [statistics(t).astype(np.float32) for t in f["text"]]})

    rows = docs.select(as_text(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return as_long(rows.mapInPandas(run, "doc_id string, x array<float>"), "doc_id")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES, ridge: float = 0.03, seed: int = 7) -> Model:
    """Learn from rows of ``stats`` (doc_id, x) whose fold is not held out; labels that repeat or differ are averaged.

    Three folds give the normal equations and one the calibration. Without usable labels every score is 0.5; with
    labels of one kind it is that label.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    known = durable(stats.join(y, "doc_id").withColumn("fold", fold("doc_id", MODULUS)).where(F.col("fold") != HELD_OUT).select("x", "y", "fold"), "quality-known")
    x = [F.col("x")[i].cast("double") for i in range(N_STATS)]
    m = known.agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    rng = np.random.default_rng(seed)
    width = np.sqrt(N_STATS) * 1.5  # kernel width in standardized units
    w, b = rng.standard_normal((N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features)
    if not m[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), w, b)
    scale = np.array(m[2 + N_STATS :], dtype=float)
    model = Model(np.array(m[2 : 2 + N_STATS], dtype=float), np.where(scale > 1e-9, scale, 1.0), w, b)
    d = features + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((d, d)), np.zeros(d)
        for f in batches:
            if len(f):
                z = model.features(np.stack(f["x"].to_numpy()).astype(float))
                gram += z.T @ z
                right += z.T @ f["y"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "rhs": [right.tobytes()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((d, d)), np.zeros(d)
        for f in batches:
            for g, r in zip(f["gram"], f["rhs"], strict=True):
                gram += np.frombuffer(g).reshape(d, d)
                right += np.frombuffer(r)
        yield pd.DataFrame({"gram": [gram.tobytes()], "rhs": [right.tobytes()]})

    sums = known.where(F.col("fold") != CALIBRATION).select("x", "y").mapInPandas(partial, "gram binary, rhs binary")
    levels = [8]  # eight sums reach the driver, however many partitions there were: a tree whose width grows with the rows
    while levels[-1] * 64 * ROWS_A_SUM < m[0]:
        levels.append(levels[-1] * 64)
    for width in reversed(levels):
        sums = sums.repartition(width).mapInPandas(merged, "gram binary, rhs binary")
    gram, right = np.zeros((d, d)), np.zeros(d)
    for r in sums.toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(d, d)
        right += np.frombuffer(r.rhs)
    penalty = np.full(d, ridge)
    penalty[0] = 1e-6
    model.beta = np.linalg.solve(gram + np.diag(penalty), right) if gram[0, 0] else None

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                raw = model.raw(np.stack(f["x"].to_numpy()).astype(float))
                yield pd.DataFrame({"cell": _grid(raw), "raw": raw, "y": f["y"]})

    use = known.where(F.col("fold") == CALIBRATION)
    got = use.select("x", "y").mapInPandas(cells, "cell long, raw double, y double").groupBy("cell").agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    if len(got):
        # half a document of the overall rate smooths the pools' ends away from 0 and 1
        knots, values = isotonic(got["raw"].to_numpy(), got["y"].to_numpy() + 0.02 * m[1], got["n"].to_numpy() + 0.02)
        model.knots, model.values = knots, values
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0]) if model.beta is not None else np.array([m[1], m[1]])
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                s = model.score(np.stack(f["x"].to_numpy()).astype(float))
                yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    rows = stats.select(as_text("doc_id").alias("doc_id"), (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "x")
    return as_long(rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int"), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``, learned from ``labels``.

    Null and empty texts are scored like any other; a null id is in the held-out test's fold of the empty text; repeated
    rows are scored alike; other columns are not read; an empty table gives no rows.
    """
    stats = durable(document_statistics(docs, id_col, text_col), "quality-stats")
    return score(stats, fit(stats, labels, id_col="doc_id", **options), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with predicted 1, columns unchanged: statistics ride along and no text is shuffled."""
    names = list(docs.columns)
    mark = free_name(names, "_x")

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t).astype(np.float32) for t in texts])

    marked = durable(docs.withColumn(mark, of(F.col(text_col).cast("string"))), "quality-marked")
    stats = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(mark).alias("x"))
    model = fit(stats, labels, id_col="doc_id", **options)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return marked.where(scored(F.col(mark)) >= threshold).select(*[F.col(f"`{c}`") for c in names])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
