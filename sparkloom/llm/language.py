"""Language identification by hierarchical discrimination.

First a document's family, by one linear support vector machine for each pair of families; then, within the family, one
for each pair of its languages, so that close relatives are told apart by machines that saw nothing else. Inputs are
hashed byte bigrams and trigrams of the whole lower-cased text without digits and marks.

The machines are fitted on a bounded sample (``max_rows``, dealt evenly over languages by a hash of the id); counts of
every language come from all rows. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, fold, table

MODULUS, HELD_OUT = 3, 1
MAX_ROWS = 1_500
BITS2, BITS3 = 10, 12
DIM = (1 << BITS2) + (1 << BITS3)
UNKNOWN = "und"

#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl",
}

_LETTER = regex.compile(r"\p{L}")
_SPACE = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalpha():
        _SPACE[_c] = 32
_TO_SPACE = _SPACE.tobytes()


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    """A language's family; one that is not listed is its own."""
    return next((f for f, members in families.items() if lang in members.split()), f"={lang}")


def has_letter(text: str | None) -> bool:
    """Whether a text has any letter; null has none."""
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str | None) -> np.ndarray:
    """Hashed bigram and trigram frequencies of a whole text, square-rooted and of length 1; zeros without any."""
    out = np.zeros(DIM, dtype=np.float32)
    if not text:
        return out
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()) + b" ", np.uint8)
    step = 1 << 22  # a very long text is counted in pieces; two bytes of overlap keep every gram
    two, three = np.zeros(1 << BITS2), np.zeros(1 << BITS3)
    for at in range(0, len(b), step):
        x = b[at : at + step + 2].astype(np.uint32)
        pair = x[:-1] << np.uint32(8) | x[1:]
        full = pair[:-1] << np.uint32(8) | x[2:]
        two += np.bincount(pair[:step] * np.uint32(2654435761) >> np.uint32(32 - BITS2), minlength=1 << BITS2)
        three += np.bincount(full[:step] * np.uint32(2654435761) >> np.uint32(32 - BITS3), minlength=1 << BITS3)
    for v, part in ((two, out[: 1 << BITS2]), (three, out[1 << BITS2 :])):
        if s := v.sum():
            part[:] = np.sqrt(v / (2 * s))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> np.ndarray:
    """Weights (last: bias) of a squared-hinge support vector machine by accelerated gradient steps; y is -1 or 1.

    Both sides weigh the same in sum, so a language with few rows keeps its ground.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    ahead, t = w.copy(), 1.0
    lam = 1.0 / (c * 100)
    rate = 1.0 / (2 * 2.0 + lam)  # rows have length at most sqrt(2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = lam * ahead - 2 * (x.T @ (weight * y * slack))
        new = ahead - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


@dataclass
class Model:
    """Machines as one matrix: rows are pairs, first of families and then of each family's languages."""

    families: list[str]
    members: dict[str, list[str]]
    weights: np.ndarray
    slopes: np.ndarray
    family_pairs: list[tuple[int, int, int]]
    language_pairs: dict[str, list[tuple[int, int, int]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(margins * self.slopes, -30, 30)))
        family_p = _couple(p, self.family_pairs, len(self.families))
        which = family_p.argmax(axis=1)
        langs, score = [""] * len(x), np.zeros(len(x))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(which == f)
            if len(rows):
                q = _couple(p[rows], self.language_pairs[name], len(self.members[name]))
                best = q.argmax(axis=1)
                score[rows] = family_p[rows, f] * q[np.arange(len(rows)), best]
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    langs[r] = self.members[name][b]
        return langs, score


def _couple(p: np.ndarray, pairs: list[tuple[int, int, int]], k: int) -> np.ndarray:
    """Pairwise probabilities to one distribution: 1 / (sum over rivals of 1 / p - (k - 2)), scaled."""
    if k == 1:
        return np.ones((len(p), 1))
    odds = np.zeros((len(p), k))
    for row, a, b in pairs:
        odds[:, a] += 1 / np.maximum(p[:, row], 1e-12)
        odds[:, b] += 1 / np.maximum(1 - p[:, row], 1e-12)
    out = 1 / (odds - (k - 2))
    return out / out.sum(axis=1, keepdims=True)


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve through 0 that fits the margins best, on a fixed grid."""
    grid = np.geomspace(0.5, 12, 24)
    return float(grid[np.argmin([np.mean(np.logaddexp(0, -g * margin * y)) for g in grid])])


def fit_rows(x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    """Machines from rows of features: between families, then between the languages of each. Copies count as often as they come."""
    known = sorted(set(langs))
    of = {lang: family_of(lang, families) for lang in known}
    names = sorted(set(of.values()))
    members = {f: [lang for lang in known if of[lang] == f] for f in names}
    lang, fam = np.array(langs), np.array([of[v] for v in langs])
    weights, slopes, family_pairs, language_pairs = [], [], [], {f: [] for f in names}

    def add(label: np.ndarray, one: str, two: str, pairs: list, a: int, b: int) -> None:
        rows = (label == one) | (label == two)
        y = np.where(label[rows] == one, 1, -1).astype(np.float32)
        w = linear_svm(x[rows], y)
        pairs.append((len(weights), a, b))
        weights.append(w)
        slopes.append(_slope(x[rows] @ w[:-1] + w[-1], y))

    for (a, one), (b, two) in combinations(enumerate(names), 2):
        add(fam, one, two, family_pairs, a, b)
    for f in names:
        for (a, one), (b, two) in combinations(enumerate(members[f]), 2):
            add(lang, one, two, language_pairs[f], a, b)
    matrix = np.array(weights, dtype=np.float32) if weights else np.zeros((0, DIM + 1), dtype=np.float32)
    return Model(names, members, matrix, np.array(slopes, dtype=np.float32), family_pairs, language_pairs)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, families: dict[str, str] = FAMILIES) -> Model | None:
    """Learn from rows with a language and a letter outside the held-out fold; None if there are none.

    All languages' rows are counted; then each language gives its ``max_rows / languages`` rows, or all if fewer,
    chosen by a hash of the id (the hash cuts at a share of its range, so no rank over a language is taken).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", MODULUS) != HELD_OUT))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    each = max(20, max_rows // len(counts))
    at = (F.xxhash64("id", F.lit(11)).cast("double") / float(1 << 63) + 1) / 2
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    sample = rows.where(at <= share[F.col("lang")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            f = f[[has_letter(t) for t in f["text"]]]
            if len(f):
                yield pd.DataFrame({"lang": f["lang"], "x": [grams(t).astype(np.float16).tobytes() for t in f["text"]]})

    got = sample.select("lang", "text").mapInPandas(run, "lang string, x binary").orderBy("lang", "x").toPandas()
    if not len(got):
        return None
    return fit_rows(np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32), got["lang"].tolist(), families)


def _predictor(model: Model | None):
    def run(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        for at in range(0, len(some), 512):
            part = some[at : at + 512]
            got, s = model.predict(np.stack([grams(texts[i]) for i in part]))
            score[part] = s
            for i, lang in zip(part, got, strict=True):
                langs[i] = lang
        return langs, np.clip(score, 0, 1)

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing could be learned;
    a null id has the fold of the empty text; repeated rows are predicted alike; other columns are not read.
    """
    predict = _predictor(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            langs, score = predict(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": langs, "score": score})

    rows = docs.select(as_text(id_col).alias("doc_id"), (fold(id_col, MODULUS) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return as_long(rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"), "doc_id")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = 0.5, wanted: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language was found: not ``und``, score at least ``min_score``, one of ``wanted`` if given."""
    predict = _predictor(model)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        langs, score = predict(texts.tolist())
        return pd.Series([v != UNKNOWN and s >= min_score and (wanted is None or v in wanted) for v, s in zip(langs, score, strict=True)], dtype=bool)

    return docs.where(kept(F.col(text_col).cast("string")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
