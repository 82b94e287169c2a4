"""Set and vector functions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def added(source: Column, target: Column) -> Column:
    return F.sort_array(F.array_except(target, source))


def removed(source: Column, target: Column) -> Column:
    return F.sort_array(F.array_except(source, target))


def preserved(source: Column, target: Column) -> Column:
    return F.sort_array(F.array_intersect(source, target))


def delta_size(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two sets."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def share(part: Column, whole: Column, empty: float) -> Column:
    """size(part) / size(whole), or `empty` if the whole has nothing."""
    return F.when(F.size(whole) == 0, F.lit(empty)).otherwise(F.size(part) / F.size(whole))


def recall(candidate: Column, target: Column) -> Column:
    """|c & t| / |t| over distinct items; 0 if either is empty."""
    return share(F.array_intersect(candidate, target), F.array_distinct(target), 0.0)


def precision(candidate: Column, target: Column) -> Column:
    return share(F.array_intersect(candidate, target), F.array_distinct(candidate), 0.0)


def similarity(candidate: Column, target: Column) -> Column:
    return F.greatest(recall(candidate, target), precision(candidate, target))


def lexical_score(query: Column, candidate: Column, least: int = 4) -> Column:
    """Share of the query's tokens of at least `least` characters, repeats included, that the candidate has."""
    q = F.filter(query, lambda t: F.length(t) >= least)
    return share(F.filter(q, lambda t: F.array_contains(candidate, t)), q, 0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a lambda's body is computed anew for each element, and with it what it takes from outside."""
    return F.transform(F.array(value), f)[0]


def unit(v: Column) -> Column:
    """v over its length, which counts as at least 1e-12."""
    return let(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 if either is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def mean_pool(tokens: Column, mask: Column, truncate: int | None = None) -> Column:
    """Unit mean of the token vectors whose mask is not 0; its first `truncate` values, again at unit length, if given. Null if no token counts."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m != 0, t)), lambda t: t.isNotNull())
    first = lambda k: F.transform(F.try_element_at(k, F.lit(1)), lambda x: x.cast("double"))
    total = lambda k: F.aggregate(F.slice(k, 2, 1 << 30), first(k), lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    # The length of a sum is that of the mean up to a factor: both have the same unit vector.
    pooled = let(kept, lambda k: unit(total(k)))
    return unit(F.slice(pooled, 1, truncate)) if truncate is not None else pooled
