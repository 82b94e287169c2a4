"""Rows by key: latest, first, ordinals, dense indexes, top-k, quotas. Every order is explicit and total where the caller's is."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.storage import written


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of the given columns."""
    return _first(df, keys, [F.col(c).desc() for c in order])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of the given columns."""
    return _first(df, keys, [F.col(c).asc() for c in order])


def latest_values(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As latest_by for a few columns, as one aggregate: partial results are combined before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def distinct_with_ordinal(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "ordinal") -> DataFrame:
    """Number the rows of each key, then keep each value's first row with the number it had."""
    return first_by(ordinal(df, keys, order, name), [*keys, value], [name])


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of the order, written: _part is a row's range and _local its place there, from 0.

    The number of ranges is fixed, so that no later plan merges some of them; the written table keeps them as they are
    if executors are lost.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition's number above the row's, in 33 bits
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", place)
    return written(ranged.withColumns({"_part": F.shiftright("_m", 33).cast("int"), "_local": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"), "ranges")


def _based(t: DataFrame, size: Column, local: str, name: str) -> DataFrame:
    """name = local plus the sizes of all ranges before: one row for each range is broadcast."""
    sizes = t.groupBy("_part").agg(size.alias("_size"))
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return t.join(F.broadcast(base), "_part").withColumn(name, (F.col(local) + F.col("_base")).cast("long"))


def dense_index(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """0, 1, 2, ... in the order of the given columns: no task holds more than one range of them."""
    return _based(_ranged(df, order), F.count("*"), "_local", name).drop("_part", "_local", "_base")


def sum_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of value over all rows before, in the order of the given columns: no task holds more than one range of them."""
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = _ranged(df, order).withColumn("_own", own)
    return _based(t, F.sum(value), "_own", name).drop("_part", "_local", "_own", "_base")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts to k in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def balanced_order(df: DataFrame, stratum: str, order: str, name: str = "position", most: int | None = None) -> DataFrame:
    """Round robin over the strata in key order, each in its own order; numbered from 1.

    Only the first `most` if given: they are among the first `most` of each stratum, to which Spark cuts in each task.
    """
    if most is not None:
        within = top_k(df, [stratum], [F.col(order)], most, "_turn")
    else:
        indexed = dense_index(df, [stratum, order], "_turn")
        base = indexed.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_turn").alias("_base"))
        within = indexed.join(base, F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("_turn", F.col("_turn") - F.col("_base") + 1).drop("_stratum", "_base")
    out = dense_index(within, ["_turn", stratum], name).withColumn(name, (F.col(name) + 1).cast("int")).drop("_turn")
    return out if most is None else out.where(F.col(name) <= most)


def coherent_prefix(df: DataFrame, chain: str, turn: str, ok: str) -> DataFrame:
    """truncate_at: a chain's first turn that is not ok; prefix_end: its last turn before that."""
    w = Window.partitionBy(chain)
    cut = df.withColumn("truncate_at", F.min(F.when(~F.coalesce(F.col(ok), F.lit(False)), F.col(turn))).over(w))
    return cut.withColumn("prefix_end", F.max(F.when(F.col("truncate_at").isNull() | (F.col(turn) < F.col("truncate_at")), F.col(turn))).over(w))


#: Distinct values of average_rank() up to which the table of their ranks is broadcast.
RANKS_BROADCAST = 100_000


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs, nulls last.

    Each key's values are counted, and the counts summed up in ranges of their order: no task holds all rows of a key.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_none", F.col("_v").isNull())
    t = written(sum_before(counts, [*keys, "_none", "_v"], "_n", "_pre"), "ranks")
    base = t.groupBy(*(F.col(k).alias(f"_b{j}") for j, k in enumerate(keys))).agg(F.min("_pre").alias("_base"))
    same = lambda pairs: reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs), F.lit(True))
    own = [(k, f"_b{j}") for j, k in enumerate(keys)]
    t = t.join(base, same(own)).select(*(F.col(k).alias(f"_r{j}") for j, k in enumerate(keys)), F.col("_v").alias("_rv"), (F.col("_pre") - F.col("_base") + 1 + (F.col("_n") - 1) / 2).alias(name))
    few = t.limit(RANKS_BROADCAST + 1).count() <= RANKS_BROADCAST
    ranks = F.broadcast(t) if few else t
    return df.join(ranks, same([(k, f"_r{j}") for j, k in enumerate(keys)] + [(value, "_rv")])).select(*df.columns, name)


def quota_pick(df: DataFrame, keys: list[str], kind: str, quotas: dict[str, int], order: list[Column], fill: list[Column], most: int) -> DataFrame:
    """The first rows of each kind up to its quota, then the best of the rest until there are `most`; position counts from 1."""
    own = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    quota = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(kind)), F.lit(0))
    marked = df.withColumn("in_quota", own <= quota)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("in_quota").desc(), *fill))
    return marked.withColumn("position", place).where(F.col("position") <= most)
