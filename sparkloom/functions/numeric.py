"""Numeric functions that answer null where a ratio is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def number(c: Column | str, default: float | None = 0.0) -> Column:
    """Coerced to double; what is no number is ``default``."""
    out = col(c).try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def growth(now: Column, before: Column) -> Column:
    """now / before - 1; null where before is 0 or either is null."""
    return F.try_divide(now.cast("double"), before.cast("double")) - 1


def half_even(c: Column | str, digits: int = 2) -> Column:
    """Rounded to ``digits``, halves to the even neighbour."""
    return F.bround(col(c), digits)


def bins(c: Column | str, edges: list[float]) -> Column:
    """Right-closed intervals as text; null outside."""
    c = col(c)
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((c > a) & (c <= b), F.lit(f"({a:g}, {b:g}]")).otherwise(out)
    return out


def interaction(likes: Column, reposts: Column, replies: Column, quotes: Column, weights: tuple[float, ...] = (1, 3, 2, 2)) -> Column:
    """A weighted sum of reactions; a missing one counts as 0."""
    return sum((number(c) * w for c, w in zip((likes, reposts, replies, quotes), weights, strict=True)), F.lit(0.0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate over rows with both; null for a constant series (the built-in raises there)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers."""
    product = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null where either has length 0."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def unit(a: Column | str) -> Column:
    """An array scaled to length 1."""
    n = norm(a)
    return F.transform(col(a), lambda x: F.try_divide(x.cast("double"), F.nullif(n, F.lit(0.0))))
