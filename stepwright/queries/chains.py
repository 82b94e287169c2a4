"""Gate, selection and sampling (inventory 2.6, 2.11, 2.13) over instruction variants and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import labels as L
from stepwright.functions import sampling as S
from stepwright.operators import gate as T
from stepwright.operators import graph as G
from stepwright.operators import joins as N
from stepwright.operators import keys as K
from stepwright.queries.registry import query
from stepwright.sources.writers import duplicate_count, merge_records

_J = lambda c: F.array_join(c, "|")
_U = "CAST('0x' || substr(sha1({}), 1, 13) AS BIGINT) / 4503599627370496.0"


def _u(seed, *keys: str) -> str:
    return _U.format(f"'{seed}:' || " + " || ':' || ".join(keys))


_SCORE = "CASE WHEN (chain_id + turn + variant) % 17 = 0 THEN NULL ELSE score_a END"


def _scored(spark, sf):
    """Variants with a rating that some lack."""
    return B.variants(spark, sf).withColumn("score", F.when((F.col("chain_id") + F.col("turn") + F.col("variant")) % 17 != 0, F.col("score_a")))


_GRADE_SQL = f"""{B.VARIANTS_SQL}, v AS (SELECT *, {_SCORE} AS score, coalesce({_SCORE} >= 4, false) AS passed FROM variants),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, turn ORDER BY passed DESC, score DESC NULLS LAST, variant) AS r FROM v) WHERE r = 1),
agg AS (SELECT chain_id, turn, list(variant ORDER BY variant) FILTER (passed) AS passing, count(score) AS n_rated FROM v GROUP BY ALL),
s1 AS (SELECT chain_id, turn, variant AS best_variant, score AS best_score, passed AS step_accepted, passed AND variant <> 0 AS fallback_used, passing, n_rated,
       min(score) OVER (PARTITION BY chain_id) AS chain_score, min(CASE WHEN NOT passed THEN turn END) OVER (PARTITION BY chain_id) AS truncate_at FROM best JOIN agg USING (chain_id, turn)),
steps AS (SELECT *, max(CASE WHEN truncate_at IS NULL OR turn < truncate_at THEN turn END) OVER (PARTITION BY chain_id) AS prefix_end FROM s1)"""


@query(f"WITH {_GRADE_SQL} SELECT chain_id, turn, best_variant, best_score, step_accepted, fallback_used, coalesce(array_to_string(passing, '|'), '') AS passing, n_rated, chain_score, truncate_at, prefix_end FROM steps")
def gate_grades(spark, sf):
    g = T.grade(_scored(spark, sf), "score")
    return g.select("chain_id", "turn", "best_variant", "best_score", "step_accepted", "fallback_used", _J(F.transform("passing", lambda x: x.cast("string"))).alias("passing"), "n_rated", "chain_score", "truncate_at", "prefix_end")


@query(f"WITH {_GRADE_SQL} SELECT chain_id, turn, best_variant, step_accepted, coalesce(step_accepted AND turn <= prefix_end, false) AS contextual_accepted FROM steps")
def gate_selected(spark, sf):
    return T.select(T.grade(_scored(spark, sf), "score")).select("chain_id", "turn", "best_variant", "step_accepted", "contextual_accepted")


@query(f"WITH {_GRADE_SQL} SELECT chain_id, turn, best_variant FROM steps WHERE step_accepted AND turn <= prefix_end")
def gate_truncated(spark, sf):
    return T.select(T.grade(_scored(spark, sf), "score"), "truncate").select("chain_id", "turn", "best_variant")


@query(f"WITH {_GRADE_SQL} SELECT DISTINCT chain_id, truncate_at, prefix_end FROM steps")
def chain_prefix(spark, sf):
    return T.grade(_scored(spark, sf), "score").select("chain_id", "truncate_at", "prefix_end").distinct()


@query(f"""WITH {B.VARIANTS_SQL}, v AS (SELECT *, {_SCORE} AS score, coalesce({_SCORE} >= 4, false) AS passed FROM variants)
SELECT chain_id, turn, variant, passed FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, turn ORDER BY passed DESC, CASE WHEN passed THEN variant END, score DESC NULLS LAST, variant) AS r FROM v) WHERE r = 1""")
def first_policy_variants(spark, sf):
    return T.best_variants(T.rated(_scored(spark, sf), "score"), "score", "first").select("chain_id", "turn", "variant", "passed")


@query(f"WITH {B.VARIANTS_SQL} SELECT chain_id, CASE WHEN count(s) = count(*) THEN round(avg(s), 6) END AS score_mean, round(avg(score_b), 6) AS score_b_mean FROM (SELECT *, {_SCORE} AS s FROM variants WHERE variant = 0) GROUP BY chain_id")
def judge_chain_means(spark, sf):
    m = T.judge_means(_scored(spark, sf).where("variant = 0"), ["score", "score_b"])
    return m.select("chain_id", F.round("score_mean", 6).alias("score_mean"), F.round("score_b_mean", 6).alias("score_b_mean"))


_BEST_SQL = f"""{B.VARIANTS_SQL}, s AS (SELECT chain_id, turn, max(CASE WHEN least(score_a, score_b) >= 2 THEN (score_a + score_b) / 2.0 END) AS step_score FROM variants GROUP BY ALL),
c AS (SELECT chain_id, count(*) AS steps, avg(step_score) AS chain_score FROM s GROUP BY chain_id HAVING count(*) = count(step_score))"""


@query(f"WITH {_BEST_SQL} SELECT chain_id, steps, round(chain_score, 6) AS chain_score FROM c ORDER BY round(chain_score, 9) DESC, chain_id LIMIT 200")
def best_variant_chains(spark, sf):
    c = T.best_chains(B.variants(spark, sf), ["score_a", "score_b"], 2)
    return c.orderBy(F.round("chain_score", 9).desc(), "chain_id").limit(200).withColumn("chain_score", F.round("chain_score", 6))


@query(f"""WITH {_BEST_SQL}, d AS (SELECT chain_id, steps, round(chain_score, 6) AS chain_score, ['a', 'b', 'c', 'd', 'e'][chain_id % 5 + 1] AS kind FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY chain_score DESC, chain_id) > 1 AS again FROM d)
SELECT chain_id, kind, chain_score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY again, chain_score DESC, chain_id) AS place FROM r) WHERE place <= 40""")
def diverse_chains(spark, sf):
    c = T.best_chains(B.variants(spark, sf), ["score_a", "score_b"], 2).withColumn("chain_score", F.round("chain_score", 6))
    c = c.withColumn("kind", F.element_at(F.array(*map(F.lit, "abcde")), (F.pmod("chain_id", F.lit(5)) + 1).cast("int")))
    return T.diverse(c, "kind", "chain_score", "chain_id", 40).select("chain_id", "kind", "chain_score", "place")


@query(f"WITH {B.VARIANTS_SQL} SELECT chain_id, turn, variant, score_a FROM variants WHERE variant < 2")
def variant_cap(spark, sf):
    return K.top_k(B.variants(spark, sf), ["chain_id", "turn"], [F.col("variant")], 2).select("chain_id", "turn", "variant", "score_a")


@query(f"""WITH {B.VARIANTS_SQL}, p AS (SELECT a.chain_id, a.turn, a.variant AS a, b.variant AS b, CAST('0x' || substr(sha1(a.chain_id || ':' || a.turn || ':' || a.variant || ':' || b.variant), 1, 2) AS INTEGER) % 2 = 1 AS swapped
FROM variants a JOIN variants b ON a.chain_id = b.chain_id AND a.turn = b.turn AND a.variant < b.variant)
SELECT chain_id, turn, CASE WHEN swapped THEN b ELSE a END AS left, CASE WHEN swapped THEN a ELSE b END AS right, swapped FROM p""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def variant_pairs(spark, sf):
    return N.variant_pairs(B.variants(spark, sf), ["chain_id", "turn"], "variant")


@query(f"""WITH {B.VARIANTS_SQL} SELECT v.chain_id, v.turn, v.variant FROM variants v WHERE v.turn = 2 AND (v.chain_id % 4 = 0 OR v.chain_id % 4 = 1 AND v.variant IN (0, 2))""")
def assigned_variants(spark, sf):
    v = B.variants(spark, sf)
    a = v.where("turn = 2 and chain_id % 4 < 2").select("chain_id", "turn").distinct()
    a = a.withColumn("variant_indices", F.when(F.col("chain_id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(2))))
    return N.assigned(v, a, ["chain_id", "turn"], "variant").select("chain_id", "turn", "variant")


@query(f"WITH {B.VARIANTS_SQL} SELECT chain_id, turn, max(variant) AS variant, arg_max(score_b, variant) AS score_b FROM variants GROUP BY ALL")
def merged_records(spark, sf):
    return merge_records(B.variants(spark, sf), ["chain_id", "turn"], ["variant"]).select("chain_id", "turn", "variant", "score_b")


@query("SELECT count(*) AS records, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def merge_duplicates(spark, sf):
    return duplicate_count(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_STRATA = f"""{B.VARIANTS_SQL}, s AS (SELECT chain_id, turn, count(*) AS n, min(hardness) AS hardness FROM variants GROUP BY ALL),
k AS (SELECT *, hardness || '/' || CASE WHEN turn <= 1 THEN 'early' WHEN turn <= 3 THEN 'middle' ELSE 'late' END AS stratum, sha1(chain_id || ':' || turn) AS h FROM s)"""


def _strata(spark, sf):
    s = B.variants(spark, sf).groupBy("chain_id", "turn").agg(F.count("*").alias("n"), F.min("hardness").alias("hardness"))
    return s.withColumns({"stratum": F.concat_ws("/", "hardness", L.turn_band(F.col("turn"))), "h": L.digest(F.col("chain_id"), F.col("turn"))})


@query(f"""WITH {_STRATA}, o AS (SELECT *, row_number() OVER (ORDER BY t, stratum) AS position FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS t FROM k)),
b AS (SELECT *, CASE WHEN position <= 20 THEN 'sentinel' WHEN position <= 60 THEN 'core_overlap' ELSE 'extension' END AS bucket FROM o WHERE position <= 150)
SELECT chain_id, turn, stratum, bucket, 'hv_' || lpad(CAST(row_number() OVER (ORDER BY CASE bucket WHEN 'sentinel' THEN 0 WHEN 'core_overlap' THEN 1 ELSE 2 END, h) - 1 AS VARCHAR), 5, '0') AS assignment_id FROM b""")
def stratified_assignment(spark, sf):
    o = K.balanced_order(_strata(spark, sf), "stratum", "h", most=150)
    bucket = F.when(F.col("position") <= 20, "sentinel").when(F.col("position") <= 60, "core_overlap").otherwise("extension")
    b = o.withColumn("bucket", bucket)
    rank = F.when(F.col("bucket") == "sentinel", 0).when(F.col("bucket") == "core_overlap", 1).otherwise(2)
    n = F.row_number().over(Window.orderBy(rank, "h")) - 1
    return b.select("chain_id", "turn", "stratum", "bucket", F.concat(F.lit("hv_"), F.lpad(n.cast("string"), 5, "0")).alias("assignment_id"))


@query(f"WITH {_STRATA} SELECT chain_id, arg_min(turn, h) AS turn FROM k GROUP BY chain_id")
def one_step_per_chain(spark, sf):
    return _strata(spark, sf).groupBy("chain_id").agg(F.min_by("turn", "h").alias("turn"))


@query(f"""WITH {_STRATA}, o AS (SELECT *, n > 1 AS sentinel, row_number() OVER (PARTITION BY n > 1 ORDER BY h, chain_id, turn) - 1 AS i FROM k)
SELECT chain_id, turn, sentinel, row_number() OVER (ORDER BY i // 5, {_u('order', 'h')}, chain_id, turn) AS place FROM o""")
def session_order(spark, sf):
    """Batches of ten over all steps: five sentinels and five others, as far as there are both, shuffled within the batch."""
    s = _strata(spark, sf).withColumn("sentinel", F.col("n") > 1)
    of = lambda c: K.dense_index(s.where(c), ["h", "chain_id", "turn"], "i")
    o = of("sentinel").unionByName(of("not sentinel")).withColumns({"batch": F.floor(F.col("i") / 5), "u": S.uniform("order", F.col("h"))})
    return K.dense_index(o, ["batch", "u", "chain_id", "turn"], "place").select("chain_id", "turn", "sentinel", (F.col("place") + 1).alias("place"))


@query(f"SELECT conv_id, turn, CASE WHEN u < 0.4 THEN 'short' WHEN u < 0.7 THEN 'medium' ELSE 'long' END AS verbosity FROM (SELECT conv_id, turn, {_u(7, 'conv_id', 'turn')} AS u FROM conversations)")
def verbosity_sample(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", S.verbosity(S.uniform(7, F.col("conv_id"), F.col("turn"))).alias("verbosity"))


@query(f"""SELECT conv_id, turn, total, CAST(1 + extra AS INTEGER) AS changes, CAST(total - 1 - extra AS INTEGER) AS preservations FROM (SELECT *, CASE WHEN total > 1 AND u1 < 0.67 THEN 1 ELSE 0 END + CASE WHEN total > 2 AND u2 < 0.67 THEN 1 ELSE 0 END + CASE WHEN total > 3 AND u3 < 0.67 THEN 1 ELSE 0 END AS extra
FROM (SELECT conv_id, turn, CAST(CASE WHEN u < 0.5 THEN 1 WHEN u < 0.8 THEN 2 WHEN u < 0.95 THEN 3 ELSE 4 END AS INTEGER) AS total, {_u(9, 'conv_id', 'turn', '1')} AS u1, {_u(9, 'conv_id', 'turn', '2')} AS u2, {_u(9, 'conv_id', 'turn', '3')} AS u3
FROM (SELECT conv_id, turn, {_u(9, 'conv_id', 'turn', '0')} AS u FROM conversations)))""")
def clause_budget(spark, sf):
    u = lambda k: S.uniform(9, F.col("conv_id"), F.col("turn"), F.lit(k))
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", S.clause_total(u(0)).alias("total"))
    extra = sum((F.when((F.col("total") > k) & (u(k) < 0.67), 1).otherwise(0) for k in (1, 2, 3)), F.lit(0))
    return c.select("conv_id", "turn", "total", (1 + extra).alias("changes"), (F.col("total") - 1 - extra).alias("preservations"))


_FOCUS = [a for a in L.AXES if a != "other"]


@query(f"""WITH counts AS (SELECT a AS axis, count(d.doc_id) AS n FROM (SELECT unnest([{', '.join(repr(a) for a in _FOCUS)}]) AS a, unnest(range({len(_FOCUS)})) AS i) LEFT JOIN documents d ON d.doc_id % 13 = i GROUP BY a)
SELECT conv_id, turn, arg_min(axis, (k, axis)) AS axis FROM (SELECT conv_id, turn, axis, -ln(greatest({_u(3, 'conv_id', 'turn', 'axis')}, 1e-300)) / greatest(CASE WHEN axis = 'genre_style' THEN 0.2 ELSE 1.0 END / (n + 1), 1e-12) AS k FROM conversations, counts) GROUP BY conv_id, turn""")
def axis_sample(spark, sf):
    """One axis for each turn, drawn in inverse proportion to how often the axis was used, genre_style at a fifth of that."""
    used = B.table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(13)).cast("int").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    axes = spark.createDataFrame(list(enumerate(_FOCUS)), "i int, axis string").join(used, "i", "left").fillna(0, ["n"]).select("axis", "n")
    t = B.table(spark, sf, "conversations").select("conv_id", "turn").crossJoin(F.broadcast(axes))
    key = S.exponential_key(S.uniform(3, F.col("conv_id"), F.col("turn"), F.col("axis")), F.when(F.col("axis") == "genre_style", 0.2).otherwise(1.0) / (F.col("n") + 1))
    return t.groupBy("conv_id", "turn").agg(F.min_by("axis", F.struct(key, "axis")).alias("axis"))


_STATE = f"""{B.TURNS_SQL}, s AS (SELECT chain_id, turn, {B.turn_tags_sql('text')} AS t, {B.turn_tags_sql("coalesce(previous, '')")} AS p FROM turns),
e AS (SELECT chain_id, turn, unnest(list_filter(t, lambda x: NOT list_contains(p, x))) AS tag, 1 AS op FROM s UNION ALL SELECT chain_id, turn, unnest(list_filter(p, lambda x: NOT list_contains(t, x))), 0 FROM s),
l AS (SELECT s.chain_id, s.turn, e.tag, arg_max(e.op, e.turn) AS op FROM s JOIN e ON e.chain_id = s.chain_id AND e.turn <= s.turn GROUP BY ALL)
SELECT s.chain_id, s.turn, coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (op = 1), '') AS added_cumulative, coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (op = 0), '') AS removed_cumulative
FROM s LEFT JOIN l ON l.chain_id = s.chain_id AND l.turn = s.turn GROUP BY s.chain_id, s.turn"""


def _steps(spark, sf):
    from stepwright.functions import arrays as A

    t = B.turns(spark, sf).select("chain_id", "turn", B.turn_tags(F.col("text")).alias("t"), B.turn_tags(F.coalesce("previous", F.lit(""))).alias("p"))
    return t.select("chain_id", "turn", A.added(F.col("p"), F.col("t")).alias("tags_added"), A.removed(F.col("p"), F.col("t")).alias("tags_removed"))


@query(f"WITH {_STATE}")
def accumulated_tag_state(spark, sf):
    s = G.cumulative_state(_steps(spark, sf))
    return s.select("chain_id", "turn", _J("added_cumulative").alias("added_cumulative"), _J("removed_cumulative").alias("removed_cumulative"))


@query("""SELECT conv_id AS chain_id, CAST(count(*) AS INTEGER) AS chain_length, min(turn) AS seed_turn, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS steps FROM conversations GROUP BY conv_id""")
def chain_records(spark, sf):
    r = G.chain_records(B.turns(spark, sf), ["role"])
    line = F.array_join(F.transform("steps", lambda s: F.concat(s["turn"].cast("string"), F.lit(":"), s["role"])), " ")
    return r.select("chain_id", "chain_length", F.col("seed.turn").alias("seed_turn"), line.alias("steps"))


@query(f"WITH {B.VARIANTS_SQL} SELECT c.o_orderkey AS chain_id, v.turn, v.variant, v.score_a FROM orders c LEFT JOIN variants v ON v.chain_id = c.o_orderkey WHERE c.o_orderkey < 3000")
def step_flattening(spark, sf):
    """Nested steps and variants as one row each; chains without a step stay."""
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("chain_id"))
    v = B.variants(spark, sf).groupBy("chain_id").agg(F.collect_list(F.struct("turn", "variant", "score_a")).alias("steps"))
    return o.join(v, "chain_id", "left").select("chain_id", F.explode_outer("steps").alias("s")).select("chain_id", "s.turn", "s.variant", "s.score_a")


@query("""WITH c AS (SELECT conv_id AS chain_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT chain_id, n, CAST(least(n, 120 - pre) AS BIGINT) AS taken FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY chain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM c) WHERE least(n, 120 - pre) > 0""")
def step_cap_prefix(spark, sf):
    c = B.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("chain_id")).agg(F.count("*").alias("n"))
    return T.capped(c, "chain_id", "n", 120)


@query("""(SELECT 'low' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25) UNION ALL (SELECT 'high', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)""")
def top_bottom(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    low = o.orderBy("o_totalprice", "o_orderkey").limit(25).select(F.lit("low").alias("side"), "*")
    return low.unionAll(o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select(F.lit("high").alias("side"), "*"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def pagination(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(40).limit(20)


@query(f"WITH {B.TURNS_SQL} SELECT chain_id, turn, role, CASE WHEN turn % 3 <= 1 THEN 'easy' ELSE 'medium' END AS hardness FROM turns WHERE chain_id IN (3, 5, 8) ORDER BY chain_id, turn")
def timeline_rows(spark, sf):
    return B.turns(spark, sf).where(F.col("chain_id").isin(3, 5, 8)).select("chain_id", "turn", "role", L.hardness(F.pmod("turn", F.lit(3))).alias("hardness")).orderBy("chain_id", "turn")


@query(f"""WITH {B.VARIANTS_SQL} SELECT CASE WHEN score_a >= 4 AND score_b >= 4 THEN 'both' WHEN score_a >= 4 OR score_b >= 4 THEN 'either' ELSE 'none' END AS accepted, count(*) AS n FROM variants GROUP BY 1""")
def accept_combine(spark, sf):
    a, b = F.col("score_a") >= 4, F.col("score_b") >= 4
    label = F.when(T.accept_both(a, b), "both").when(T.accept_both(a, b, False), "either").otherwise("none")
    return B.variants(spark, sf).groupBy(label.alias("accepted")).agg(F.count("*").alias("n"))
