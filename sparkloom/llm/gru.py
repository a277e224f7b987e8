"""Scoring documents with a gated recurrent language model.

Counts of every word come from one pass and one aggregate over the corpus. The most frequent training words, an end
token and spelling buckets for all other words are the model's outputs, factored into classes: log P(class) + log
P(output | class), and for a word in a bucket + log P(word | bucket) from the counts. So every text has a proper
probability. The network is plain numpy: warm-started on the driver from a bounded sample by truncated backpropagation,
then refined on the executors over all training documents, in tasks of about equally many, whose parameters are averaged.

Texts are turned into outputs once, two bytes a token; training and scoring both read those. Scoring is one pass:
documents are dealt to lanes, lanes run window by window, and a lane's state is carried from window to window (and
cleared between documents), so a text of any length is scored whole in bounded memory. The commonest ``HEAD`` words of
all documents and their counts travel with the tasks; occurrences of rarer words, a small share, are joined to their
counts by word. No frequent word is in that join, wherever it occurs, so it has no hot key.
"""

from __future__ import annotations

import contextlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fold, table

MODULUS, HELD_OUT = 10, 0
HEAD = 200_000
HIDDEN, CLASSES, WIDTH, BUCKETS = 16, 32, 64, 1024
OUTPUTS = CLASSES * WIDTH
WINDOW, LANES = 32, 512
#: Training: documents of the driver's sample, its steps, documents of a refiner, and models averaged in one task.
WARM_DOCS, WARM_STEPS, REFINER_DOCS, FAN_IN = 1500, 300, 8000, 16
REFINE_RATE = 0.006


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bucket_of(word: bytes) -> int:
    """A word's spelling bucket: by its last two bytes."""
    return zlib.crc32(word[-2:]) % BUCKETS


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """Rows (word, c, a): training occurrences (rows with ``held_out`` false; all, if there is no such column) and all
    occurrences of each word of ``docs``. Each task adds up what it has read before the shuffle; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            c, h = (np.fromiter(map(s.__getitem__, words), dtype=np.int64, count=len(words)) for s in seen)
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(c), pa.array(c + h)], ["word", "c", "a"])

        for f in batches:
            for t, h in zip(f.column("text").to_pylist(), f.column("held_out").to_pylist(), strict=True):
                seen[h].update(words_of(t))
                if len(seen[0]) + len(seen[1]) > flush:
                    yield out()
                    seen = (Counter(), Counter())
        if seen[0] or seen[1]:
            yield out()

    held = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), held.alias("held_out")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "word string, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


@dataclass
class Lexicon:
    """What tasks need of the counts; at most HEAD words."""

    ids: dict[bytes, int]
    output: np.ndarray  # a head word's output
    base: np.ndarray  # log10 of its smoothed share of all tokens
    inner: np.ndarray  # log10 P(word | output): 0 for an output of its own
    known: np.ndarray
    bucket_norm: np.ndarray  # log10 of each bucket's smoothed total
    norm: float  # log10 of the smoothed total of all tokens
    end_base: float
    end_known: int
    total: int


def build_lexicon(counts: DataFrame, n_docs: int, head: int = HEAD) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the counts of the model's outputs (end, buckets, words). ``n_docs``: training documents."""
    bucket = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)), F.lit(BUCKETS)).cast("int")
    sums = counts.where("c > 0").groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # BUCKETS rows
    # the head: as many steps of a logarithmic scale of counts, from the top, as hold at most ``head`` words
    level = F.floor(F.log2(F.col("a").cast("double")) * 64)
    steps = sorted(((r.s, r.n) for r in counts.groupBy(level.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a few thousand rows at most
    held, lowest = 0, None
    for s, n in steps:
        if held + n > head:
            break
        held, lowest = held + n, s
    top = counts.where(level >= (lowest if lowest is not None else 1 << 30)).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words, c = [w.encode("utf-8") for w in top["word"]], top["c"].to_numpy(dtype=np.int64)
    n_b, v_b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        n_b[r.b], v_b[r.b] = r.c, r.v
    total = int(n_b.sum()) + n_docs
    distinct = int(v_b.sum()) + (n_docs > 0)
    own = min(int((c > 0).sum()), OUTPUTS - BUCKETS - 1)
    where = np.array([bucket_of(w) for w in words], dtype=np.int64).reshape(-1)
    for i in range(own):
        n_b[where[i]] -= c[i]
        v_b[where[i]] -= 1
    bucket_norm = np.log10(n_b + 0.1 * (v_b + 1))
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    output = np.concatenate([np.arange(own) + BUCKETS + 1, where[own:] + 1]).astype(np.int32)
    inner = np.concatenate([np.zeros(own), np.log10(c[own:] + 0.1) - bucket_norm[where[own:]]])
    lex = Lexicon(dict(zip(words, range(len(words)), strict=True)), output, np.log10(c + 0.1) - norm, inner, c > 0, bucket_norm, norm, float(np.log10(n_docs + 0.1)) - norm, int(n_docs > 0), total)
    out = np.zeros(OUTPUTS)
    out[0], out[1 : BUCKETS + 1], out[BUCKETS + 1 : BUCKETS + 1 + own] = n_docs, n_b, c[:own]
    return lex, out


def keep_freed_memory() -> None:
    """Let this worker reuse what it frees: the C library else returns a window's arrays, a few MB, and fetches them anew page
    by page for the next. At most a quarter of a GB is kept; without the GNU library nothing happens."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


class Network:
    """Gated recurrent unit with a class-factored softmax; output o is place ``place[o]`` of class ``cls[o]``.

    The last row of ``wc`` and of each matrix of ``ww`` is its bias, met by a constant 1 behind the state. Gates are
    (1 + tanh(a)) / 2. Sums run over rows sorted by class, so that each class is one product of matrices.
    """

    NAMES = ("x", "u", "wc", "ww")

    def __init__(self, counts: np.ndarray, seed: int = 0):
        rng, h = np.random.default_rng(seed), HIDDEN
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(OUTPUTS, dtype=np.int64)
        rank[order] = np.arange(OUTPUTS)
        self.cls, self.place = (rank // WIDTH).astype(np.int32), (rank % WIDTH).astype(np.int32)  # classes of like frequency
        p = np.log(counts[order].reshape(CLASSES, WIDTH) + 0.5)
        total = np.log(np.exp(p).sum(axis=1))
        self.x = (rng.standard_normal((OUTPUTS, 3 * h)) * 0.1).astype(np.float32)
        self.u = (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.wc, self.ww = np.zeros((h + 1, CLASSES), np.float32), np.zeros((CLASSES, h + 1, WIDTH), np.float32)
        self.wc[h], self.ww[:, h] = total - total.max(), p - total[:, None]

    def parameters(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        """Take over parameters that ``parameters`` gave."""
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next state; the two gates side by side, the state's part in the candidate, the candidate."""
        k = HIDDEN
        r = h @ self.u
        zr = gates[:, : 2 * k] + r[:, : 2 * k]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = zr[:, k:] * r[:, 2 * k :]
        n += gates[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:, :k]
        new += n
        return new, zr, r[:, 2 * k :], n

    def _by_class(self, hidden: np.ndarray, target: np.ndarray) -> tuple:
        """Exponentials over classes and, sorted by class, over the places of the target's class; rows, log P(target) sorted."""
        cls = self.cls[target]
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        flat, cls, place, rows = hidden[order], cls[order], self.place[target[order]], np.arange(len(target))
        outer, inner = flat @ self.wc, np.empty((len(target), WIDTH), flat.dtype)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if b > a:
                np.matmul(flat[a:b], self.ww[c], out=inner[a:b])
        for part, w in ((outer, self.wc), (inner, self.ww)):
            if np.abs(w).sum(axis=-2).max() > 60:  # states are within 1: no exponential can overflow below that
                part -= part.max(axis=1, keepdims=True)
        log_p = outer[rows, cls] + inner[rows, place]
        np.exp(outer, out=outer)
        np.exp(inner, out=inner)
        sum_o, sum_i = outer @ np.ones(CLASSES, outer.dtype), inner @ np.ones(WIDTH, inner.dtype)
        log_p -= np.log(sum_o) + np.log(sum_i)
        return outer, inner, sum_o, sum_i, order, edges, flat, cls, place, rows, log_p

    def log_probs(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log P(target) for each row of ``hidden``."""
        ones = np.ones((len(hidden), 1), hidden.dtype)
        got = self._by_class(np.concatenate([hidden, ones], axis=1), target)
        out = np.empty_like(got[-1])
        out[got[4]] = got[-1]
        return out

    def gradients(self, inp: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean loss, gradients and last state of one window (lanes x steps); the state's past is not followed."""
        b, t = inp.shape
        k, kind = HIDDEN, self.u.dtype
        hs, past, zr, un, n = np.ones((t, b, k + 1), kind), np.empty((t, b, k), kind), np.empty((t, b, 2 * k), kind), np.empty((t, b, k), kind), np.empty((t, b, k), kind)
        gates, stay = self.x[inp.T], (1 - fresh).T[:, :, None].astype(kind)
        for i in range(t):
            np.multiply(h, stay[i], out=past[i])
            h, zr[i], un[i], n[i] = self.step(gates[i], past[i])
            hs[i, :, :k] = h
        tgt = target.T.ravel()
        outer, inner, sum_o, sum_i, order, edges, flat, cls, place, rows, log_p = self._by_class(hs.reshape(-1, k + 1), tgt)
        count = len(tgt)
        outer /= (sum_o * count)[:, None]
        inner /= (sum_i * count)[:, None]
        outer[rows, cls] -= 1 / count
        inner[rows, place] -= 1 / count
        grad = {"wc": flat.T @ outer, "ww": np.zeros_like(self.ww)}
        back_rows = outer @ self.wc[:k].T
        for c in range(CLASSES):
            lo, hi = edges[c], edges[c + 1]
            if hi > lo:
                np.matmul(flat[lo:hi].T, inner[lo:hi], out=grad["ww"][c])
                back_rows[lo:hi] += inner[lo:hi] @ self.ww[c, :k].T
        dh = np.empty_like(back_rows)
        dh[order] = back_rows
        dh = dh.reshape(t, b, k)
        z, g = zr[:, :, :k], zr[:, :, k:]
        by_n = (1 - z) * (1 - n * n)
        by_z = 2 * (past - n) * z * (1 - z)
        by_g = 2 * un * g * (1 - g)
        back, dgates, du = np.zeros((b, k), kind), np.empty((t, b, 3 * k), kind), np.empty((t, b, 3 * k), kind)
        turned = np.ascontiguousarray(self.u.T)
        for i in reversed(range(t)):
            d = dh[i] + back
            into, dn = dgates[i], d * by_n[i]
            np.multiply(d, by_z[i], out=into[:, :k])
            np.multiply(dn, by_g[i], out=into[:, k : 2 * k])
            into[:, 2 * k :] = dn
            du[i] = into
            du[i, :, 2 * k :] *= g[i]
            back = du[i] @ turned
            d *= z[i]
            back += d
            back *= stay[i]
        grad["u"] = past.reshape(-1, k).T @ du.reshape(-1, 3 * k)
        at = inp.T.ravel()
        sort = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], at[sort][1:] != at[sort][:-1]]))
        grad["x"] = np.zeros_like(self.x)
        grad["x"][at[sort[starts]]] = np.add.reduceat(dgates.reshape(-1, 3 * k)[sort], starts, axis=0)
        return float(-log_p.sum() / count), grad, h

    def train(self, docs: list[np.ndarray], steps: int | None, rate: float, lanes: int = 256, seed: int = 0) -> int:
        """Truncated backpropagation with Adam over ``docs`` (arrays of outputs), round and round for ``steps`` windows, or once
        over every token: what the lanes do not divide is a lane of its own, last."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return 0
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        v = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        done, tokens = 0, 0
        while steps is None or done < steps:
            stream = np.concatenate([docs[i] for i in rng.permutation(len(docs))]).astype(np.int32)
            before = np.concatenate([[0], stream[:-1]]).astype(np.int32)
            fresh = (before == 0).astype(np.float32)
            use = min(lanes, max(1, len(stream) // WINDOW))
            length = len(stream) // use if steps is None else len(stream) // use // WINDOW * WINDOW or len(stream) // use
            blocks = [(slice(0, use * length), use)] + ([(slice(use * length, None), 1)] if steps is None and use * length < len(stream) else [])
            for span, wide in blocks:
                inp, tgt, new = before[span].reshape(wide, -1), stream[span].reshape(wide, -1), fresh[span].reshape(wide, -1)
                new[:, 0] = 1
                h = np.zeros((wide, HIDDEN), np.float32)
                for at in range(0, inp.shape[1], WINDOW):
                    if steps is not None and done >= steps:
                        break
                    w = slice(at, at + WINDOW)
                    _, grad, h = self.gradients(inp[:, w], tgt[:, w], new[:, w], h)
                    done += 1
                    tokens += inp[:, w].size
                    lr = rate * min(1.0, done / 20) * (1.0 if steps is None else max(0.1, 1 - done / steps))
                    norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                    shrink = min(1.0, 1.0 / (norm + 1e-12))
                    for n in self.NAMES:
                        g = grad[n] * np.float32(shrink)
                        m[n] += np.float32(0.1) * (g - m[n])
                        v[n] += np.float32(0.01) * (g * g - v[n])
                        a = np.float32(lr / (1 - 0.9**done))
                        getattr(self, n)[...] -= a * m[n] / (np.sqrt(v[n] / np.float32(1 - 0.99**done)) + np.float32(1e-7))
            if steps is None:
                break
        return tokens

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each array of outputs (its end included).

        Lanes stand by length, longest first, so that those still running are the first of them in every window.
        """
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        out = np.zeros(len(docs))
        if not len(docs) or not sizes.sum():
            return out
        free = [(0, i) for i in range(int(min(LANES, max(1, sizes.sum() // WINDOW))))]
        line: list[list[int]] = [[] for _ in free]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, i = heapq.heappop(free)
            line[i].append(d)
            heapq.heappush(free, (n + int(sizes[d]), i))
        line = [line[i] for n, i in sorted(free, reverse=True) if n]
        order = np.concatenate(line)
        tgt, owner = np.concatenate([docs[d] for d in order]).astype(np.int32), np.repeat(order, sizes[order])
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        inp = np.where(fresh, 0, np.concatenate([[0], tgt[:-1]])).astype(np.int32)
        length = np.array([int(sizes[ds].sum()) for ds in line])
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        h = np.zeros((len(line), HIDDEN), np.float32)
        for at in range(0, int(length[0]), WINDOW):
            live = int(np.searchsorted(-length, -at))  # lanes longer than ``at``
            n = min(WINDOW, int(length[0]) - at)
            where = at + np.arange(n)[:, None]
            inside = where < length[:live]
            index = np.where(inside, begin[:live] + where, 0)
            hs, gates, new = np.empty((n, live, HIDDEN), np.float32), self.x[inp[index]], fresh[index] & inside
            starts, h = new.any(axis=1).tolist(), h[:live]
            for i in range(n):
                if starts[i]:
                    h = np.where(new[i][:, None], np.float32(0), h)
                h = hs[i] = self.step(gates[i], h)[0]
            if inside.all():
                hidden, index = hs.reshape(-1, HIDDEN), index.ravel()
            else:
                hidden, index = hs[inside], index[inside]
            out += np.bincount(owner[index], weights=self.log_probs(hidden, tgt[index]), minlength=len(docs))
        return out / np.log(10)


def _outputs(words: list[bytes], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Head ids (-1: not in the head), the model's outputs with the end, and the words outside the head."""
    get = lex.ids.get
    ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
    out = np.zeros(len(words) + 1, dtype=np.int32)
    if len(words):
        if len(lex.output):
            out[:-1] = lex.output[ids]
        rare = np.flatnonzero(ids < 0)
        tail = [words[i] for i in rare.tolist()]
        out[rare] = [bucket_of(w) + 1 for w in tail]
        return ids, out, tail
    return ids, out, []


CODED = "id long, held_out boolean, n_tokens long, n_known long, base double, inner double, outputs binary, tail array<string>"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """One row for each of ``docs`` (id, held_out, text): its outputs, two bytes each, and everything that its words in the
    head add to the scores; ``tail`` are its words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for f in batches:
            counted, sums, coded, tails = [], [], [], []
            for t in f.column("text").to_pylist():
                words = words_of(t)
                ids, outputs, tail = _outputs(words, lex)
                head = ids[ids >= 0]
                counted.append((len(words) + 1, int(lex.known[head].sum()) + lex.end_known))
                base = float(lex.base[head].sum()) + lex.end_base - lex.norm * len(tail)
                sums.append((base, float(lex.inner[head].sum()) - float(lex.bucket_norm[outputs[:-1][ids < 0] - 1].sum())))
                coded.append(outputs.astype(np.uint16).tobytes())
                tails.append([w.decode("utf-8", "replace") for w in tail])
            n, x = np.array(counted, np.int64).reshape(-1, 2), np.array(sums, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [f.column("id"), f.column("held_out"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(coded, pa.binary()), pa.array(tails, pa.list_(pa.string()))],
                ["id", "held_out", "n_tokens", "n_known", "base", "inner", "outputs", "tail"],
            )

    return docs.select("id", "held_out", "text").mapInArrow(run, CODED)


def learn(docs: DataFrame, lex: Lexicon, counts: np.ndarray, seed: int = 0) -> Network:
    """``learn_coded`` for training rows (id, text)."""
    return learn_coded(encode(docs.withColumn("held_out", F.lit(False)), lex).withColumn("row", F.monotonically_increasing_id()), counts, seed)


def learn_coded(coded: DataFrame, counts: np.ndarray, seed: int = 0) -> Network:
    """Warm start on the driver, then refinement on executors over every row and a mean weighted by tokens.

    ``coded``: (row, outputs), training rows. Rows are dealt to refiners by a hash of their number, about REFINER_DOCS
    each, so that no source, id or repeated text gathers in one. Without rows the network is that of the counts.
    """
    net = Network(counts, seed)
    n = coded.count()
    hashed = coded.select(F.xxhash64("row", F.lit(21)).alias("h"), "outputs")
    warm = hashed.where(F.pmod("h", F.lit(max(1, n // WARM_DOCS))) == 0).orderBy("h").limit(2 * WARM_DOCS).toPandas()
    net.train([np.frombuffer(b, np.uint16) for b in warm["outputs"]], WARM_STEPS, 0.01, seed=seed)
    start = net.parameters()

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own = Network(counts, seed)
        own.load(start)
        held, size, tokens = [], 0, 0
        for f in batches:
            for b in f.column("outputs").to_pylist():
                held.append(np.frombuffer(b, np.uint16))
                size += len(held[-1])
                if size > 2_000_000:
                    tokens += own.train(held, None, REFINE_RATE, seed=seed)
                    held, size = [], 0
        tokens += own.train(held, None, REFINE_RATE, seed=seed)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.parameters().tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["at", "p", "n"])

    tasks = max(1, -(-n // REFINER_DOCS))
    models = durable(hashed.repartition(tasks, "h").sortWithinPartitions("h").select("outputs").mapInArrow(refine, MODEL), "lm-models")
    highest = models.agg(F.max("at")).first()[0]
    if highest is not None:
        net.load(np.frombuffer(mean_model(models, highest + 1).first().p, np.float64))
    return net


MODEL = "at long, p binary, n long"


def mean_model(models: DataFrame, tasks: int) -> DataFrame:
    """At most one row (at, p, n): the mean of ``models``' parameters (float32), weighted by n, in float64.

    Models meet FAN_IN at a time, level upon level, so no task holds many and the driver gets one.
    """

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        f, total = f.sort_values("at"), int(f["n"].sum())
        p = sum(np.frombuffer(b, np.float64) * (n / total) for b, n in zip(f["p"], f["n"], strict=True))
        return pd.DataFrame({"at": [int(f["at"].iloc[0]) // FAN_IN], "p": [p.tobytes()], "n": [total]})

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.assign(p=[np.frombuffer(b, np.float32).astype(np.float64).tobytes() for b in f["p"]])

    out, left = models.mapInPandas(widen, MODEL), tasks
    while True:
        out, left = out.groupBy(F.floor(F.col("at") / FAN_IN)).applyInPandas(mean, MODEL), -(-left // FAN_IN)
        if left <= 1:
            return out


SCORED = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score_pass(coded: DataFrame, net: Network, tokens_at_once: int = 3_000_000) -> DataFrame:
    """What ``encode`` gave (and ``row``) with a score: everything but what the counts of rare words add."""
    shared = coded.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        net = shared.value
        held: list[pa.RecordBatch] = []
        arrays: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            scores, at = net.score(arrays), 0
            for f in held:
                own = scores[at : at + len(f)] + f.column("inner").to_numpy()
                yield pa.RecordBatch.from_arrays([*(f.column(n) for n in ("row", "id", "held_out", "n_tokens", "n_known", "base")), pa.array(own)], ["row", "id", "held_out", "n_tokens", "n_known", "base", "score"])
                at += len(f)

        size = 0
        for f in batches:
            held.append(f)
            arrays += [np.frombuffer(b, np.uint16) for b in f.column("outputs").to_pylist()]
            size += int(f.column("n_tokens").to_numpy().sum())
            if size >= tokens_at_once:
                yield from out()
                held, arrays, size = [], [], 0
        if held:
            yield from out()

    return coded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "inner", "outputs").mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, seed: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Learns from rows outside the held-out fold. Null and empty texts are a lone end token; a null id has the fold of the
    empty text; repeated rows are scored alike; other columns are not read; without training rows every share is of the
    smoothing alone. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, MODULUS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = durable(word_counts(rows), "lm-counts")
    lex, outputs = build_lexicon(counts, rows.where("not held_out").count(), head)
    coded = durable(encode(rows, lex).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    net = learn_coded(coded.where("not held_out"), outputs, seed)
    done = durable(score_pass(coded, net), "lm-scores")
    rare = coded.select("row", F.explode("tail").alias("word"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("t"), F.count_if(F.col("c") > 0).alias("k"))
    out = done.join(met, "row", "left")
    t, k = F.coalesce("t", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + k).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + t).alias("base_score"), (F.col("score") + t).alias("score"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
