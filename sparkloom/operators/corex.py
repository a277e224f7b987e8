"""Topics by anchored correlation explanation (Ver Steeg and Galstyan, 2014; Gallagher, Reing, Kale and Ver Steeg, 2017).

Hidden binary topics are sought that explain the total correlation of binary words. A round reads the sparse documents once:
every task turns its documents into topic probabilities and adds up, for each word and topic, the probability mass of the
documents that hold the word; these sums meet in an aggregate by word. What the driver holds is a number for each word of
the vocabulary and topic, and the vocabulary is limited by a parameter. Anchored words keep a fixed strength in their topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable

#: Share of the newest strengths in each round, and what is added to every count.
PACE, SMOOTH, STRIP = 0.3, 0.5, 512


@dataclass
class Model:
    """A fitted model: ``words``, and arrays of words by topics (strengths, probabilities of a word with and without the topic)."""

    words: list[str]
    alpha: np.ndarray
    with_topic: np.ndarray
    without: np.ndarray
    alone: np.ndarray
    share: np.ndarray
    information: np.ndarray
    correlation: np.ndarray

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood ratios against a word's own rate: constants with and without each topic, and what a present word adds."""
        rows = []
        for p, prior in ((self.with_topic, self.share), (self.without, 1 - self.share)):
            absent = self.alpha * (np.log1p(-p) - np.log1p(-self.alone[:, None]))
            present = self.alpha * (np.log(p) - np.log(self.alone[:, None]))
            rows += [np.log(prior) + absent.sum(axis=0), present - absent]
        return tuple(rows)

    def top_words(self, k: int = 10) -> list[tuple[int, int, str, float, float]]:
        """(topic, rank, word, information, strength): of the words that lean to a topic most, those that tell most about it."""
        out = []
        lean = self.alpha.argmax(axis=1)
        for j in range(self.alpha.shape[1]):
            mine = np.flatnonzero(lean == j)
            for r, i in enumerate(mine[np.argsort(-np.round(self.information[mine, j], 12), kind="stable")][:k]):
                out.append((j, r + 1, self.words[i], float(self.information[i, j]), float(self.alpha[i, j])))
        return out


def expit(odds: np.ndarray) -> np.ndarray:
    """Probabilities of log-odds, without overflow."""
    return np.exp(-np.logaddexp(0, -odds))


def scores(ids: list[np.ndarray], terms: tuple, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of each topic, log of its normaliser) of documents given by the numbers of their words."""
    c1, d1, c0, d0 = terms
    a1, a0 = np.tile(c1, (len(ids), 1)), np.tile(c0, (len(ids), 1))
    for k, i in enumerate(ids):
        if len(i):
            a1[k] += d1[i].sum(axis=0)
            a0[k] += d0[i].sum(axis=0)
    z = np.logaddexp(a1, a0)
    return a1 - a0, z


def updated(words: list[str], held: np.ndarray, sums: np.ndarray, mass: np.ndarray, n: int, alpha: np.ndarray | None, anchors: dict[tuple[int, int], float]) -> Model:
    """The next model from the sums of a round: ``held`` documents of each word, ``sums`` of probability by word and topic."""
    share = np.clip((mass + SMOOTH) / (n + 2 * SMOOTH), 1e-9, 1 - 1e-9)
    with_topic = (sums + SMOOTH) / (mass + 2 * SMOOTH)
    without = (held[:, None] - sums + SMOOTH) / (n - mass + 2 * SMOOTH)
    alone = (held + SMOOTH) / (n + 2 * SMOOTH)
    mixed = share * with_topic + (1 - share) * without
    information = sum(s * p * np.log(p / q) for s, x in ((share, with_topic), (1 - share, without)) for p, q in ((x, mixed), (1 - x, 1 - mixed)))
    best = np.zeros_like(information)
    best[np.arange(len(words)), np.round(information, 12).argmax(axis=1)] = 1
    alpha = best if alpha is None else (1 - PACE) * alpha + PACE * best
    for (i, j), strength in anchors.items():
        alpha[i, j] = strength
    return Model(words, alpha, with_topic, without, alone, share, information, np.zeros(len(share)))


def vocabulary(bags: DataFrame, documents: int, min_df: int, max_share: float, max_terms: int) -> DataFrame:
    """(term, held): words in at least ``min_df`` documents and at most ``max_share`` of them; of more than ``max_terms``, the most frequent.

    ``bags``: rows with ``words``, an array; what moves is a count for each word and task."""
    held = bags.select(F.explode(F.array_distinct("words")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    return held.where((F.col("held") >= min_df) & (F.col("held") <= max_share * documents)).orderBy(F.desc("held"), "term").limit(max_terms)


def coded(words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (doc, words) as (doc, ids), the sorted numbers of a document's words among ``words``, ``STRIP`` documents at a time:
    words stay in Arrow's buffers and never are objects of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, STRIP):
                b = whole.slice(at, STRIP)
                bags = b.column(1)
                found = pc.index_in(bags.flatten().cast(pa.string()), value_set=known)
                row, number = pc.list_parent_indices(bags).filter(found.is_valid()).to_numpy(), found.drop_null().to_numpy()
                pairs = np.unique(row.astype(np.int64) * len(words) + number)
                ends = np.searchsorted(pairs, np.arange(b.num_rows + 1) * len(words))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % len(words), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc", "ids"])

    return run


def beginnings(topics: int, seed: int):
    """Seeded first probabilities of a document's topics, from its key alone."""
    return F.array(*[F.pmod(F.xxhash64("doc", F.lit(j), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) for j in range(topics)])


def fit(docs: DataFrame, topics: int = 10, anchors: list[list[str]] = (), strength: float = 3.0, seed: int = 42, rounds: int = 30, tolerance: float = 1e-4, min_df: int = 5, max_share: float = 0.8, max_terms: int = 20_000) -> tuple[Model, DataFrame]:
    """(model, documents): ``docs`` holds every key as ``doc`` once and its ``words``, an array, repeats without effect.

    The second result is (doc, ids), for ``label``. Anchor words outside the vocabulary have no effect; a document without
    words of the vocabulary is one whose words are all absent; null words and arrays are empty; an empty vocabulary is an
    error.
    """
    n = docs.count()
    rows = vocabulary(docs, n, min_df, max_share, max_terms).collect()  # at most max_terms
    if not rows:
        raise ValueError("no word is in enough documents")
    words, held = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    number = {w: i for i, w in enumerate(words)}
    fixed = {(number[w], j): strength for j, group in enumerate(anchors) for w in group if w in number}
    kind = docs.schema["doc"].dataType.simpleString()

    data = durable(docs.select("doc", "words").mapInArrow(coded(words), f"doc {kind}, ids array<int>").withColumn("p", beginnings(topics, seed)), "bags")

    def summed(given: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, mass, fit_ = np.zeros((len(words), topics)), np.zeros(topics), np.zeros(topics)
            for f in batches:
                for at in range(0, len(f), STRIP):
                    ids = list(f["ids"][at : at + STRIP])
                    flat = np.concatenate(ids).astype(int) if ids else np.zeros(0, int)
                    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                    if given is None:
                        p = np.stack(f["p"][at : at + STRIP].to_numpy())
                        for j, group in enumerate(anchors):
                            mine = [number[w] for w in group if w in number]
                            if mine:
                                p[:, j] = 0.5 * p[:, j] + 0.5 * np.bincount(row, np.isin(flat, mine), len(ids)) / len(mine)
                    else:
                        odds, z = scores(ids, given, topics)
                        p, fit_ = expit(odds), fit_ + z.sum(axis=0)
                    mass += p.sum(axis=0)
                    for j in range(topics):
                        s[:, j] += np.bincount(flat, p[row, j], len(words))
            some = np.flatnonzero(s.any(axis=1))
            yield pd.DataFrame({"id": [*some, -1, -2], "s": [*s[some], mass, fit_]})

        got = data.mapInPandas(run, "id long, s array<double>").groupBy("id").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(topics)]).alias("s")).collect()  # a row a word
        by = {r[0]: np.array(r[1]) for r in got}
        zero = np.zeros(topics)
        return np.array([by.get(i, zero) for i in range(len(words))]), by.get(-1, zero), by.get(-2, zero)

    model, before = updated(words, held, *summed(None)[:2], n, None, fixed), None
    for _ in range(rounds):
        s, mass, fit_ = summed(model.terms())
        correlation = fit_ / max(n, 1)
        model = updated(words, held, s, mass, n, model.alpha, fixed)
        model.correlation = correlation
        if before is not None and abs(correlation.sum() - before) < tolerance * max(1.0, abs(before)):
            break
        before = correlation.sum()
    return model, data.select("doc", "ids")


def label(model: Model, bags: DataFrame, kind: str) -> DataFrame:
    """(doc, topic, p): the topic of the largest odds, ties to the first, and the probability of every topic."""
    given, topics = model.terms(), model.alpha.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                odds = np.concatenate([scores(list(f["ids"][at : at + STRIP]), given, topics)[0] for at in range(0, len(f), STRIP)])
                yield pd.DataFrame({"doc": f["doc"], "topic": np.round(odds, 9).argmax(axis=1), "p": list(expit(odds))})

    return bags.mapInPandas(run, f"doc {kind}, topic int, p array<double>")


def anchored_topics(df: DataFrame, doc: str, text: str, stop: list[str] = (), top: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(words, documents): (topic, rank, term, information, strength) and (doc, topic, p), by lower-case letter words without stop words, unless
    they are anchors.

    Keys must be unique and not null. A null text has no words."""
    keep = {w for g in options.get("anchors", ()) for w in g}
    drop = [w for w in stop if w not in keep]
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    docs = df.select(F.col(doc).alias("doc"), (F.array_except(words, F.array(*map(F.lit, drop))) if drop else words).alias("words"))
    model, bags = fit(docs, **options)
    found = df.sparkSession.createDataFrame(model.top_words(top), "topic int, rank int, term string, information double, strength double")
    return found, label(model, bags, docs.schema["doc"].dataType.simpleString())
