"""The graded gate: variants, steps and chains by their ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.operators.keys import coherent_prefix

KEYS = ("chain_id", "turn")


def rated(variants: DataFrame, score: str, threshold: float = 4.0) -> DataFrame:
    """variants with passed: a score at or above the threshold; without a score it does not pass."""
    return variants.withColumn("passed", F.coalesce(F.col(score) >= threshold, F.lit(False)))


def best_variants(variants: DataFrame, score: str, policy: str = "best") -> DataFrame:
    """One variant for each step: among those that pass the best (or, by policy first, the first), else the best scored.

    variants has passed; fallback_used says that another than variant 0 was taken among passing ones.
    """
    among = [F.col(score).desc_nulls_last(), F.col("variant")] if policy == "best" else [F.when(F.col("passed"), F.col("variant")), F.col(score).desc_nulls_last(), F.col("variant")]
    w = Window.partitionBy(*KEYS).orderBy(F.col("passed").desc(), *among)
    best = variants.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return best.withColumn("fallback_used", F.col("passed") & (F.col("variant") != 0))


def grade(variants: DataFrame, score: str, threshold: float = 4.0, policy: str = "best", mean: bool = False) -> DataFrame:
    """Steps with step_accepted, best_variant, best_score, passing variants, chain_score (least or mean best score over rated steps), truncate_at and prefix_end."""
    v = rated(variants, score, threshold)
    passing = v.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.when(F.col("passed"), F.col("variant")))).alias("passing"), F.count(score).alias("n_rated"))
    best = best_variants(v, score, policy).select(*KEYS, F.col("variant").alias("best_variant"), F.col(score).alias("best_score"), F.col("passed").alias("step_accepted"), "fallback_used")
    steps = best.join(passing, list(KEYS))
    chain = F.avg("best_score") if mean else F.min("best_score")
    steps = steps.withColumn("chain_score", chain.over(Window.partitionBy("chain_id")))
    return coherent_prefix(steps, "chain_id", "turn", "step_accepted")


def select(steps: DataFrame, contextual_policy: str = "keep") -> DataFrame:
    """One record for each step with contextual_accepted (accepted within the coherent prefix).

    Policy truncate leaves the steps after the prefix; drop leaves chains that are not accepted as a whole.
    """
    out = steps.withColumn("contextual_accepted", F.col("step_accepted") & F.coalesce(F.col("turn") <= F.col("prefix_end"), F.lit(False)))
    if contextual_policy == "truncate":
        return out.where("contextual_accepted")
    if contextual_policy == "drop":
        return out.where(F.col("truncate_at").isNull())
    return out


def accept_both(unaware: Column, aware: Column, require_both: bool = True) -> Column:
    return unaware & aware if require_both else unaware | aware


def judge_means(ratings: DataFrame, judges: list[str]) -> DataFrame:
    """chain_id with a mean for each judge over all turns; null if a turn has no score of that judge."""
    return ratings.groupBy("chain_id").agg(*(F.when(F.count(j) == F.count("*"), F.avg(j)).alias(f"{j}_mean") for j in judges))


def best_chains(variants: DataFrame, judges: list[str], floor: float, most: int | None = None) -> DataFrame:
    """Chains by the mean of their steps' best judge means; a variant counts if each judge gives at least `floor`; a chain needs one in each turn."""
    ok = F.least(*judges) >= floor if len(judges) > 1 else F.col(judges[0]) >= floor
    mean = sum((F.col(j) for j in judges), F.lit(0)) / len(judges)
    steps = variants.groupBy(*KEYS).agg(F.max(F.when(ok, mean)).alias("step_score"), F.min(F.when(ok, F.struct((-mean).alias("m"), F.col("variant")))).getField("variant").alias("best_variant"))
    chains = steps.groupBy("chain_id").agg(F.count("*").alias("steps"), F.count("step_score").alias("good"), F.avg("step_score").alias("chain_score")).where("steps = good").drop("good")
    out = chains.orderBy(F.col("chain_score").desc(), "chain_id")
    return out.limit(most) if most is not None else out


def diverse(chains: DataFrame, kind: str, score: str, key: str, most: int) -> DataFrame:
    """The best chain of each kind first, then the others, by score; place counts from 1."""
    first = F.row_number().over(Window.partitionBy(kind).orderBy(F.col(score).desc(), key))
    order = (F.col("_again"), F.col(score).desc(), F.col(key))
    best = chains.withColumn("_again", (first > 1).cast("int")).orderBy(*order).limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_again")


def capped(chains: DataFrame, order: str, n: str, most: int) -> DataFrame:
    """Chains in order until `most` steps are taken; `taken` says how many of a chain's steps, the last being cut."""
    # Each chain takes a step at least: the first `most` chains hold all that are taken.
    chains = chains.where(F.col(n) > 0).orderBy(order).limit(most)
    before = F.coalesce(F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chains.withColumn("taken", F.least(F.col(n), F.lit(most) - before)).where("taken > 0")
