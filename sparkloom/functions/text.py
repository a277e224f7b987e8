"""Text functions as column expressions; every pattern is matched with Unicode word characters and boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def col(c: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """A null counts as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def pattern(p: str, ignore_case: bool = True) -> str:
    """A pattern with Unicode classes and boundaries, and case aside unless told otherwise."""
    return f"(?{'i' if ignore_case else ''}uU){p}" if ignore_case else f"(?U){p}"


def has(c: Column | str, p: str) -> Column:
    """Whether the pattern is found; a null text has nothing."""
    return text_of(c).rlike(pattern(p))


def whole(c: Column | str, p: str) -> Column:
    """The pattern must match the whole text."""
    return text_of(c).rlike(pattern(rf"\A(?:{p})\z"))


def phrases(words: list[str]) -> str:
    """Any of the phrases between non-word characters, the longest first."""
    return r"(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + r")(?!\w)"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once a row. Functions of lambdas are interpreted: what stands inside one in whole is
    computed anew at each of its places, and for each element."""
    return F.transform(F.array(c), f)[0]


def squeeze(c: Column | str) -> Column:
    """Trimmed, every run of white space one space; a null text is empty."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def _mapped(c: Column, wanted: str, f) -> Column:
    """``f`` of each text in which the pattern ``wanted`` is found; only those texts go through the Arrow UDF."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.coalesce(run(F.when(c.rlike(wanted), c)), c)


def unescape_html(c: Column | str) -> Column:
    """All named and numeric character references; texts without an ampersand stay in the JVM."""
    import html

    return _mapped(text_of(c), "&", html.unescape)


def drop_urls(c: Column | str) -> Column:
    """Links to spaces; only texts that may hold one are matched against the pattern."""
    t = text_of(c)
    return F.when(t.rlike("(?i)http|www"), F.regexp_replace(t, pattern(L.URL), " ")).otherwise(t)


def drop_lower_urls(c: Column) -> Column:
    """``drop_urls`` for a text that is in lower case already."""
    return bound(c, lambda t: F.when(F.contains(t, F.lit("http")) | F.contains(t, F.lit("www.")), F.regexp_replace(t, f"(?U){L.URL}", " ")).otherwise(t))


def _plain_names(out: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(out, r"(?U)@\w+", " "), r"(?U)#(\w+)", "$1")


def clean(c: Column | str, microblog: bool = False) -> Column:
    """Unescaped, without links, white space squeezed; for microblogs pictographs get names, mentions go and hash tags become words."""
    out = unescape_html(c)
    if microblog:
        out = _plain_names(demojize(out))
    return squeeze(drop_urls(out))


def normalise_text(c: Column | str) -> Column:
    """Pictographs named, links and mentions gone, hash tags as words, ``&amp;`` undone, white space squeezed."""
    return squeeze(F.replace(_plain_names(drop_urls(demojize(text_of(c)))), F.lit("&amp;"), F.lit("&")))


def text_key(c: Column | str) -> Column:
    """Lower case, no links, no ``@#``, other than letters and digits to spaces."""
    return F.trim(F.regexp_replace(drop_lower_urls(F.lower(text_of(c))), "[^a-z0-9]+", " "))


def dup_key(c: Column | str) -> Column:
    """Like ``text_key``, but whole mentions go."""
    out = F.regexp_replace(drop_lower_urls(F.lower(text_of(c))), r"(?U)@\w+", " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def match_key(c: Column | str) -> Column:
    """Lower case, no links, ``-_/+.%`` kept."""
    return F.trim(F.regexp_replace(drop_lower_urls(F.lower(text_of(c))), r"[^a-z0-9\-_/+.%]+", " "))


def _any_of(points: Iterable[int]) -> str:
    """A pattern for one of the characters, none of them ASCII, which are passed over by one test."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return r"[[^\x00-\x7F]&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"


@cache
def _not_composed() -> frozenset[int]:
    """Characters that may change in Unicode NFC, or change what stands before them: a text without them is in NFC."""
    out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # later parts of Hangul syllables
    for p in range(0x80, 0x110000):
        x = chr(p)
        if unicodedata.combining(x) or not unicodedata.is_normalized("NFC", x):
            out.add(p)
        parts = unicodedata.decomposition(x).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(int(parts[1], 16))
    return frozenset(p for p in out if p > 0x7F)


@cache
def _not_folded() -> frozenset[int]:
    """Characters whose case folding is not what lower case makes of them; the sharp s is seen to apart."""
    plain = lambda p, x: p < 0x530 and p not in (0x130, 0x3A3) and x.casefold() == x.lower()
    return frozenset(p for p in range(0x80, 0x110000) if (x := chr(p)).casefold() != x and not plain(p, x) and x != "\u00df")


def repeat_key(c: Column | str) -> Column:
    """Raw text in Unicode NFC, case-folded and squeezed: links, digits and negations stay. Only texts with a character that
    may change in NFC, or is folded to other than its lower case, go through the Arrow UDF."""

    def fold(x: str) -> str:
        return unicodedata.normalize("NFC", x).casefold()

    folded = _mapped(text_of(c), _any_of(_not_composed() | _not_folded()), fold)
    return squeeze(F.lower(F.replace(folded, F.lit("\u00df"), F.lit("ss"))))


def nfc(c: Column | str) -> Column:
    """Unicode NFC, for which Spark has no expression; only texts with a character that may change go through the Arrow UDF."""
    return _mapped(col(c).cast("string"), _any_of(_not_composed()), lambda t: unicodedata.normalize("NFC", t))


#: Characters that are shown as pictures.
PICTOGRAPH = "[\u203c\u2049\u2139\u2190-\u21ff\u2300-\u23ff\u2460-\u24ff\u25a0-\u27bf\u2900-\u297f\u2b00-\u2bff\U0001f000-\U0001faff]"


def demojize(c: Column | str) -> Column:
    """Pictographs as `` :name: `` from their Unicode names; only texts that hold one go through the Arrow UDF. Names are
    Unicode's, not a chat program's."""
    pictograph = re.compile(PICTOGRAPH)

    def name(m: re.Match) -> str:
        return f" :{unicodedata.name(m[0], 'symbol').lower().replace(' ', '_').replace('-', '_')}: "

    return _mapped(col(c).cast("string"), PICTOGRAPH, lambda t: pictograph.sub(name, t))


def author_key(c: Column | str) -> Column:
    """A name in lower case and squeezed; empty for the marks of a deleted or missing author."""
    a = squeeze(F.lower(text_of(c)))
    return F.when(a.isin("[deleted]", "deleted", "none", "nan", "[removed]"), F.lit("")).otherwise(a)


def strip_id(c: Column | str) -> Column:
    """An id without its type mark at the start."""
    return F.trim(F.regexp_replace(text_of(c), "^t[13]_", ""))


def strip_long_id(c: Column | str) -> Column:
    """Without the long prefix at its start and without the two type marks anywhere."""
    bare = F.regexp_replace(text_of(c), "^reddit_(?:post|comment)_", "")
    return F.trim(F.replace(F.replace(bare, F.lit("t3_"), F.lit("")), F.lit("t1_"), F.lit("")))


def public_author(c: Column | str, digits: int = 16) -> Column:
    """The start of the SHA-256 of a name, for tables that leave the house; a null name stays null."""
    return F.substring(F.sha2(col(c).cast("string").cast("binary"), 256), 1, digits)


def word_count(c: Column | str) -> Column:
    """Number of runs of word characters."""
    return F.regexp_count(text_of(c), F.lit(r"(?U)\b\w+\b")).cast("long")


def space_words(c: Column | str) -> Column:
    """Number of white-space-separated words."""
    s = squeeze(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("long")


def family(c: Column | str, digits: int = 24) -> Column:
    """The start of the SHA-256 of the repeat key."""
    return F.substring(F.sha2(repeat_key(c).cast("binary"), 256), 1, digits)


def bounded_hits(c: Column | str, words: list[str]) -> Column:
    """The sorted distinct phrases found between non-word characters, lower-cased."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(pattern(phrases(words))), F.lit(0)), F.lower)))


def substring_hits(c: Column | str, words: list[str], key=match_key) -> Column:
    """The phrases found anywhere in the matching key, in the list's order."""
    return bound(key(c), lambda k: F.filter(F.array(*[F.when(F.contains(k, F.lit(w)), F.lit(w)) for w in dict.fromkeys(words)]), lambda x: x.isNotNull()))


def max_shingle_repeat(c: Column | str, n: int = 6) -> Column:
    """How often the commonest run of ``n`` words occurs: shingles are sorted and the longest run of equals counted."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    shingles = bound(F.split(squeeze(F.lower(text_of(c))), " "), lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(shingles), zero, step, lambda s: s["best"])


def repeated_filler(c: Column | str) -> Column:
    """At least 24 words and some run of six of them four times or more."""
    return (space_words(c) >= 24) & (max_shingle_repeat(c, 6) >= 4)


def literal_mentions(c: Column | str, names: list[str], least: int = 5, excluded: tuple[str, ...] = ()) -> Column:
    """Sorted distinct names found literally, the longest first where they overlap."""
    use = [n.lower() for n in names if len(n) >= least and n.lower() not in excluded]
    return bounded_hits(c, use)


def mention_status(found: Column) -> Column:
    """none, single or multiple, by how many names were found."""
    n = F.size(found)
    return F.when(n == 0, "none").when(n == 1, "single").otherwise("multiple")


def likely_english(text: Column | str, least: float = 0.1) -> Column:
    """At least that share of a text's words are common English ones."""
    words = F.split(text_key(text), " ")
    return F.size(F.filter(words, lambda w: w.isin(*L.ENGLISH_WORDS))) >= least * F.size(words)


def english(lang: Column | str, text: Column | str, short: int = 20, fallback: bool = False) -> Column:
    """Metadata decides; without it short texts pass and longer ones are left undecided (null), or with ``fallback`` go by their
    commonest words."""
    tag = F.lower(F.trim(text_of(lang)))
    said = ~tag.isin("", "nan", "none")
    out = F.when(said, tag.isin("en", "english")).when(F.char_length(text_of(text)) < short, F.lit(True))
    return out.otherwise(likely_english(text)) if fallback else out


def context_text(post: Column | str, comment: Column | str) -> Column:
    """A comment with its post before it, under headings; alone where there is no post."""
    p, c = squeeze(post), squeeze(comment)
    return F.when(p != "", F.concat(F.lit("POST CONTEXT: "), p, F.lit(" COMMENT: "), c)).otherwise(c)
