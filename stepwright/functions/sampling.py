"""Seeded draws as Column expressions: uniform numbers come from a hash of the seed and the row's keys, so that runs, retries and partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.text import text


def uniform(seed: int | str, *keys: Column) -> Column:
    """A uniform number in [0, 1): the first 52 bits of the SHA-1 of seed and keys."""
    h = F.sha1(F.concat_ws(":", F.lit(str(seed)), *(text(k) for k in keys)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def choose(u: Column, weights: list[tuple[str | int, float]]) -> Column:
    """The option whose share of the weights u falls into; the last takes what is left."""
    total = sum(max(0.0, w) for _, w in weights)
    out, upto = None, 0.0
    for option, w in weights[:-1]:
        upto += max(0.0, w) / total
        out = F.when(u < upto, F.lit(option)) if out is None else out.when(u < upto, F.lit(option))
    return out.otherwise(F.lit(weights[-1][0])) if out is not None else F.lit(weights[-1][0])


def exponential_key(u: Column, weight: Column) -> Column:
    """-ln(u) / weight: the row with the least key is a draw in proportion to the weights."""
    return -F.ln(F.greatest(u, F.lit(1e-300))) / F.greatest(weight, F.lit(1e-12))


def verbosity(u: Column, short: float = 0.4, medium: float = 0.3, long: float = 0.3) -> Column:
    return choose(u, [("short", short), ("medium", medium), ("long", long)])


def clause_total(u: Column, weights: tuple[float, ...] = (0.5, 0.3, 0.15, 0.05), most: int = 4) -> Column:
    return F.least(choose(u, [(k + 1, w) for k, w in enumerate(weights)]), F.lit(most))
