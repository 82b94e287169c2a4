"""Corpus statistics: counts, histograms, matrices, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def word_frequency(df: DataFrame, text: str, stop: tuple[str, ...], most: int = 40) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*map(F.lit, stop)), w))
    return explode_counts(df, words, "word").orderBy(F.col("n").desc(), "word").limit(most)


def histogram(df: DataFrame, value: Column, bins: int, lo: float, hi: float) -> DataFrame:
    """bin, x (its middle), lo and n for every bin; hi belongs to the last bin, values outside are left out."""
    if hi <= lo:
        raise ValueError("hi must be above lo")
    width = (hi - lo) / bins
    at = F.floor((value - lo) / width)
    counted = df.where(value.between(lo, hi)).select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = full.join(counted, "bin", "left").fillna(0, ["n"])
    return out.select("bin", F.round(lo + (F.col("bin") + 0.5) * width, 4).alias("x"), F.round(lo + F.col("bin") * width, 4).alias("lo"), "n")


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n of each value and its share among those of its keys."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def transition_matrix(df: DataFrame, source: str, target: str, most: int = 12) -> DataFrame:
    """share of each target among a source's, for the `most` frequent categories of either side; 0 where none."""
    both = df.select(F.explode(F.array(source, target)).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "c").limit(most).select("c")
    cells = both.select(F.col("c").alias(source)).crossJoin(both.select(F.col("c").alias(target)))
    n = df.groupBy(source, target).agg(F.count("*").alias("n"))
    full = cells.join(n, [source, target], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(source))
    return full.select(source, target, "n", F.when(total > 0, F.col("n") / F.when(total > 0, total)).otherwise(0.0).alias("share"))


def cooccurrence(df: DataFrame, items: str, most: int = 8) -> DataFrame:
    """n of each ordered pair of different items of one row, over the `most` frequent items; the diagonal is 0."""
    top = explode_counts(df, F.array_distinct(items)).orderBy(F.col("n").desc(), "item").limit(most).select("item")
    keep = F.broadcast(top.agg(F.collect_set("item").alias("_top")))
    rows = df.select(F.array_distinct(items).alias("i")).crossJoin(keep).select(F.filter("i", lambda x: F.array_contains("_top", x)).alias("i"))
    pairs = rows.select(F.explode("i").alias("a"), "i").select("a", F.explode("i").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    cells = top.select(F.col("item").alias("a")).crossJoin(top.select(F.col("item").alias("b")))
    return cells.join(pairs, ["a", "b"], "left").fillna(0, ["n"])


def leakage(df: DataFrame, split: str, entity: str) -> DataFrame:
    """share of a split's distinct entities that another split has as well, for each ordered pair of splits."""
    d = df.select(F.col(split).alias("a"), F.col(entity).alias("e")).distinct()
    size = d.groupBy("a").agg(F.count("*").alias("size"))
    shared = d.join(d.withColumnRenamed("a", "b"), "e").groupBy("a", "b").agg(F.count("*").alias("shared"))
    names = size.select("a")
    cells = names.crossJoin(names.withColumnRenamed("a", "b")).join(shared, ["a", "b"], "left").fillna(0, ["shared"]).join(size, "a")
    return cells.select("a", "b", "shared", (F.col("shared") / F.col("size")).alias("share"))


def top_other(df: DataFrame, value: str, most: int = 8) -> DataFrame:
    """n of the `most` frequent values and, as Other, of all the rest (and of null, and of a value of that name)."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.col("n").desc(), value).limit(most).select(F.col(value).alias("_top"))
    marked = counted.join(F.broadcast(top), F.col(value).eqNullSafe(F.col("_top")), "left")
    return marked.groupBy(F.coalesce("_top", F.lit("Other")).alias(value)).agg(F.sum("n").alias("n"))


def overview(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric and value rows of several aggregates, computed in one pass."""
    one = df.agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
    return one.unpivot([], list(metrics), "metric", "value")
