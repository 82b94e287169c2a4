"""Joins of the stages: tracks with captions, rewrites, lookups, previous outputs, prior turns, pairs of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions.labels import digest
from stepwright.functions.text import strip
from stepwright.operators.keys import first_by, latest_by


def captioned(tracks: DataFrame, captions: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    return tracks.join(captions, key, "left" if keep_missing else "inner")


def with_rewrites(manifest: DataFrame, rewrites: DataFrame, key: str, value: str, target: str, keep_unmatched: bool = True, overwrite: bool = False) -> DataFrame:
    """manifest with has_rewrite and rewritten_<target>; with overwrite, target takes the rewrite where there is one.

    A later rewrite of a key must have been chosen before (latest_by); a blank rewrite counts as none.
    """
    r = rewrites.select(key, F.nullif(strip(F.col(value)), F.lit("")).alias("_rewrite"))
    out = manifest.join(r, key, "left" if keep_unmatched else "inner")
    if not keep_unmatched:
        out = out.where(F.col("_rewrite").isNotNull())
    out = out.withColumns({"has_rewrite": F.col("_rewrite").isNotNull(), f"rewritten_{target}": F.coalesce("_rewrite", F.lit(""))})
    if overwrite:
        out = out.withColumn(target, F.coalesce("_rewrite", F.col(target)))
    return out.drop("_rewrite")


def union_of_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """All keys of any table with the columns of each, null where a table lacks the key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full_outer")
    return out


def merge_previous(now: DataFrame, before: DataFrame, key: str, order: list[str], values: list[str], first_wins: bool = True) -> DataFrame:
    """now with a previous output's values; of several previous rows the first or the last counts."""
    one = (first_by if first_wins else latest_by)(before, [key], order).select(key, *(F.col(v).alias(f"previous_{v}") for v in values))
    return now.join(one, key, "left")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def refresh_status(rows: DataFrame, artifacts: DataFrame, key: str, status: str, overwrite: bool = False) -> DataFrame:
    """ok where the artifact exists (unless it is to be overwritten); failed stays failed; else pending."""
    there = artifacts.select(key).distinct().withColumn("_there", F.lit(True))
    out = rows.join(there, key, "left")
    exists = F.coalesce("_there", F.lit(False)) & ~F.lit(overwrite)
    return out.withColumn(status, F.when(exists, "ok").when(F.col(status) == "failed", "failed").otherwise("pending")).drop("_there")


def prior_turns(steps: DataFrame, chain: str, turn: str, value: Column, upto: int = -1) -> DataFrame:
    """steps with `priors`: (turn, value) of the chain's rows before, in order, by one window instead of a self-join."""
    w = Window.partitionBy(chain).orderBy(turn).rowsBetween(Window.unboundedPreceding, upto)
    return steps.withColumn("priors", F.collect_list(F.struct(F.col(turn).alias("turn"), value.alias("value"))).over(w))


def variant_pairs(variants: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """Each unordered pair of a step's variants, shown in an order that a digest of the pair decides: left, right, swapped."""
    a = variants.select(*keys, F.col(variant).alias("a"))
    b = variants.select(*keys, F.col(variant).alias("b"))
    pairs = a.join(b, keys).where("a < b")
    odd = F.conv(F.substring(digest(*(F.col(k) for k in keys), F.col("a"), F.col("b")), 1, 2), 16, 10).cast("int") % 2 == 1
    return pairs.select(*keys, F.when(odd, F.col("b")).otherwise(F.col("a")).alias("left"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("right"), odd.alias("swapped"))


def assigned(variants: DataFrame, assignments: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """Variants of assigned steps that the assignment names; an empty list names all."""
    return variants.join(assignments, keys).where((F.size("variant_indices") == 0) | F.array_contains("variant_indices", F.col(variant)))


def referenced(manifest: DataFrame, ids: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows of the manifest that any of the id columns names."""
    named = None
    for df, column in ids:
        one = df.select(F.col(column).alias(key))
        named = one if named is None else named.union(one)
    return manifest.join(named.distinct(), key, "left_semi")


def index_union(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the primary's where both have one."""
    both = primary.withColumn("_from", F.lit(0)).unionByName(secondary.withColumn("_from", F.lit(1)))
    return first_by(both, keys, ["_from"]).drop("_from")
