"""Agreement of raters and rubric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators.keys import average_rank
from stepwright.storage import written


def pearson(x: Column, y: Column) -> Column:
    """Correlation of at least 3 pairs, null if either side does not vary."""
    ok = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.covar_pop(x, y) / F.sqrt(F.when(ok, F.var_pop(x) * F.var_pop(y))))


def kappa(x: Column, y: Column, accept: float = 4) -> Column:
    """Cohen's kappa of the accept decisions, null if chance agreement is complete."""
    a, b = (x >= accept).cast("double"), (y >= accept).cast("double")
    pe = F.avg(a) * F.avg(b) + (1 - F.avg(a)) * (1 - F.avg(b))
    return F.when(pe < 1, (F.avg((a == b).cast("double")) - pe) / F.when(pe < 1, 1 - pe))


def ac1(x: Column, y: Column, accept: float = 4) -> Column:
    """Gwet's AC1 of the accept decisions."""
    a, b = (x >= accept).cast("double"), (y >= accept).cast("double")
    pi = (F.avg(a) + F.avg(b)) / 2
    pe = 2 * pi * (1 - pi)
    return F.when(pe < 1, (F.avg((a == b).cast("double")) - pe) / F.when(pe < 1, 1 - pe))


def quadratic_kappa(x: Column, y: Column, k: int = 5) -> Column:
    """Quadratically weighted kappa over 1..k, halves rounded to even; null if both sides are one equal category."""
    a, b = (F.greatest(F.lit(1), F.least(F.lit(k), F.bround(c, 0))).cast("double") for c in (x, y))
    expected = F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)
    return F.when(expected > 1e-12, 1 - F.avg((a - b) * (a - b)) / F.when(expected > 1e-12, expected))


def agreement(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per key: n_items, means, mean_diff, mae, within1_rate, accept_agree_rate, kappa, AC1, weighted kappa, Pearson and Spearman, at 3 decimals."""
    pairs = written(pairs.select(*keys, x, y), "pairs")
    ranked = average_rank(average_rank(pairs, keys, x, "_rx"), keys, y, "_ry")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = {
        "left_mean": F.avg(a), "right_mean": F.avg(b), "mean_diff": F.avg(b) - F.avg(a), "mae": F.avg(F.abs(a - b)),
        "within1_rate": F.avg((F.abs(a - b) <= 1).cast("double")), "accept_agree_rate": F.avg(((a >= 4) == (b >= 4)).cast("double")),
        "accept_kappa": kappa(a, b), "accept_ac1": ac1(a, b), "quadratic_kappa": quadratic_kappa(a, b),
        "pearson_r": pearson(a, b), "spearman_r": pearson(F.col("_rx"), F.col("_ry")),
    }
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_items"), *(F.round(v, 3).alias(k) for k, v in out.items()))


def usable(score: Column, cannot_judge: Column, not_applicable: Column) -> Column:
    """Score of an answer that counts, null otherwise."""
    return F.when(~F.coalesce(cannot_judge, F.lit(False)) & ~F.coalesce(not_applicable, F.lit(False)), score)


def rubric_summary(answers: DataFrame, question: str = "question", score: str = "score") -> DataFrame:
    """Per question: n_scored, cannot_judge, not_applicable, mean, agree_rate (4 and above), score_1 to score_5."""
    s = usable(F.col(score), F.col("cannot_judge"), F.col("not_applicable"))
    return answers.groupBy(question).agg(
        F.count(s).alias("n_scored"), F.count_if("cannot_judge").alias("cannot_judge"), F.count_if("not_applicable").alias("not_applicable"),
        F.round(F.avg(s), 3).alias("mean"), F.round(F.avg((s >= 4).cast("double")), 3).alias("agree_rate"), *(F.count_if(s == k).alias(f"score_{k}") for k in range(1, 6)),
    )
