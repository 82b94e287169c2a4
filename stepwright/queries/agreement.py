"""Agreement and rubric aggregates (inventory 2.12, AG15 to AG22) over variants' two raters and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.operators import metrics as M
from stepwright.operators.keys import average_rank
from stepwright.queries.registry import query


def _pairs(spark, sf):
    return B.variants(spark, sf).select("hardness", F.col("score_a").alias("x"), F.col("score_b").alias("y"))


def _agreement_sql(pairs: str, keys: str) -> str:
    part = f"PARTITION BY {keys}"
    return f"""{pairs}, r AS (SELECT *, rank() OVER ({part} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx, rank() OVER ({part} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
      CAST(x >= 4 AS INTEGER) AS ax, CAST(y >= 4 AS INTEGER) AS ay FROM pairs),
    g AS (SELECT {keys}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(abs(x - y)) AS mae, avg(CAST(abs(x - y) <= 1 AS INTEGER)) AS w1, avg(CAST(ax = ay AS INTEGER)) AS po, avg(ax) AS pa, avg(ay) AS pb,
      avg((x - y) * (x - y)) AS sq, avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y) AS eq, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy, var_pop(rx) AS vrx, var_pop(ry) AS vry, covar_pop(rx, ry) AS crxy FROM r GROUP BY {keys})
    SELECT {keys}, n AS n_items, round(mx, 3) AS left_mean, round(my, 3) AS right_mean, round(my - mx, 3) AS mean_diff, round(mae, 3) AS mae, round(w1, 3) AS within1_rate, round(po, 3) AS accept_agree_rate,
      CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 3) END AS accept_kappa,
      round((po - (pa + pb) * (1 - (pa + pb) / 2)) / (1 - (pa + pb) * (1 - (pa + pb) / 2)), 3) AS accept_ac1, CASE WHEN eq > 1e-12 THEN round(1 - sq / eq, 3) END AS quadratic_kappa,
      CASE WHEN n >= 3 AND vx > 0 AND vy > 0 THEN round(cxy / sqrt(vx * vy), 3) END AS pearson_r, CASE WHEN n >= 3 AND vrx > 0 AND vry > 0 THEN round(crxy / sqrt(vrx * vry), 3) END AS spearman_r FROM g"""


@query("WITH " + _agreement_sql(f"{B.VARIANTS_SQL}, pairs AS (SELECT hardness, score_a AS x, score_b AS y FROM variants)", "hardness"))
def agreement_table(spark, sf):
    return M.agreement(_pairs(spark, sf), ["hardness"])


@query("""WITH a AS (SELECT quality, 1 - toxic AS clean, avg(quality) OVER () AS pa, avg(1 - toxic) OVER () AS pb FROM labels)
SELECT count(*) AS n, round((avg(CAST(quality = clean AS INTEGER)) - (any_value(pa) * any_value(pb) + (1 - any_value(pa)) * (1 - any_value(pb)))) / (1 - (any_value(pa) * any_value(pb) + (1 - any_value(pa)) * (1 - any_value(pb)))), 6) AS kappa,
round((avg(CAST(quality = clean AS INTEGER)) - (any_value(pa) + any_value(pb)) * (1 - (any_value(pa) + any_value(pb)) / 2)) / (1 - (any_value(pa) + any_value(pb)) * (1 - (any_value(pa) + any_value(pb)) / 2)), 6) AS ac1 FROM a""")
def binary_raters(spark, sf):
    q, c = F.col("quality"), 1 - F.col("toxic")
    return B.table(spark, sf, "labels").agg(F.count("*").alias("n"), F.round(M.kappa(q, c, 1), 6).alias("kappa"), F.round(M.ac1(q, c, 1), 6).alias("ac1"))


@query(f"WITH {B.VARIANTS_SQL} SELECT split, round(covar_pop(score_a, score_b) / sqrt(var_pop(score_a) * var_pop(score_b)), 6) AS pearson_r FROM variants GROUP BY split")
def pearson(spark, sf):
    return B.variants(spark, sf).groupBy("split").agg(F.round(M.pearson(F.col("score_a"), F.col("score_b")), 6).alias("pearson_r"))


@query(f"""WITH {B.VARIANTS_SQL}, p AS (SELECT chain_id, count(*) AS n, var_pop(score_a) AS vx, var_pop(score_b) AS vy, covar_pop(score_a, score_b) AS c FROM variants GROUP BY chain_id)
SELECT chain_id, n, CASE WHEN n >= 3 AND vx > 1e-14 AND vy > 1e-14 THEN round(c / sqrt(vx * vy), 4) END AS r FROM p""")
def pearson_small_groups(spark, sf):
    return B.variants(spark, sf).groupBy("chain_id").agg(F.count("*").alias("n"), F.round(M.pearson(F.col("score_a"), F.col("score_b")), 4).alias("r"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS average_rank FROM orders")
def spearman_ranks(spark, sf):
    return average_rank(B.table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "average_rank").select("o_orderkey", "average_rank")


_ANSWERS = f"""{B.VARIANTS_SQL}, answers AS (SELECT 'q' || turn AS question, score_a AS score, source_clip % 19 = 0 AS cannot_judge, source_clip % 23 = 0 AS not_applicable FROM variants)"""


def _answers(spark, sf):
    v = B.variants(spark, sf)
    return v.select(F.concat(F.lit("q"), "turn").alias("question"), F.col("score_a").alias("score"), (F.pmod("source_clip", F.lit(19)) == 0).alias("cannot_judge"), (F.pmod("source_clip", F.lit(23)) == 0).alias("not_applicable"))


@query(f"""WITH {_ANSWERS}, u AS (SELECT *, CASE WHEN NOT cannot_judge AND NOT not_applicable THEN score END AS s FROM answers)
SELECT question, count(s) AS n_scored, count(*) FILTER (cannot_judge) AS cannot_judge, count(*) FILTER (not_applicable) AS not_applicable, round(avg(s), 3) AS mean, round(avg(CAST(s >= 4 AS INTEGER)), 3) AS agree_rate,
{', '.join(f'count(*) FILTER (s = {k}) AS score_{k}' for k in range(1, 6))} FROM u GROUP BY question""")
def rubric_summary(spark, sf):
    return M.rubric_summary(_answers(spark, sf))


@query(f"WITH {B.VARIANTS_SQL} SELECT hardness AS model, {', '.join(f'round(avg(score_b) FILTER (turn = {k}), 6) AS q{k}' for k in range(1, 8))} FROM variants GROUP BY hardness")
def model_question_means(spark, sf):
    v = B.variants(spark, sf).select(F.col("hardness").alias("model"), F.concat(F.lit("q"), "turn").alias("question"), "score_b")
    return v.groupBy("model").pivot("question", [f"q{k}" for k in range(1, 8)]).agg(F.round(F.avg("score_b"), 6))


@query(f"WITH {B.VARIANTS_SQL} SELECT chain_id, turn, round(avg(score_a), 6) AS mean_a, count(*) AS raters FROM variants GROUP BY ALL")
def item_means(spark, sf):
    return B.variants(spark, sf).groupBy("chain_id", "turn").agg(F.round(F.avg("score_a"), 6).alias("mean_a"), F.count("*").alias("raters"))


@query(f"WITH {B.VARIANTS_SQL} SELECT chain_id, turn, max(score_a) FILTER (variant = 0) AS v0, max(score_a) FILTER (variant = 1) AS v1, max(score_a) FILTER (variant = 2) AS v2 FROM variants GROUP BY ALL")
def flatten_ratings(spark, sf):
    """A map of answers by variant, as wide columns."""
    m = B.variants(spark, sf).groupBy("chain_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("variant", "score_a"))).alias("answers"))
    return m.select("chain_id", "turn", *(F.try_element_at("answers", F.lit(k)).alias(f"v{k}") for k in range(3)))


@query(f"WITH {B.VARIANTS_SQL} SELECT score_a, score_b, count(*) AS n FROM variants GROUP BY ALL")
def joint_grid(spark, sf):
    return B.variants(spark, sf).groupBy("score_a", "score_b").agg(F.count("*").alias("n"))


@query(f"WITH {B.VARIANTS_SQL} SELECT hardness, round(avg(CAST(score_a >= 4 AS INTEGER)), 6) AS accept_rate, count(*) AS n FROM variants GROUP BY hardness")
def accept_rates(spark, sf):
    return B.variants(spark, sf).groupBy("hardness").agg(F.round(F.avg((F.col("score_a") >= 4).cast("int")), 6).alias("accept_rate"), F.count("*").alias("n"))
