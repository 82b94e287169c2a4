"""Corpus statistics (inventory 2.5) over documents, clips and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import text as X
from stepwright.operators import reports as R
from stepwright.queries.graphs import _EDGES_SQL, edges
from stepwright.queries.registry import query
from stepwright.queries.scalars import _STOP


@query("""WITH o AS (SELECT count(*) AS documents, count(DISTINCT source) AS sources, avg(n_chars) AS mean_chars, median(n_chars) AS median_chars, sum(n_chars) / 1000.0 AS kilo_chars FROM documents)
SELECT metric, round(value, 4) AS value FROM (SELECT 'documents' AS metric, CAST(documents AS DOUBLE) AS value FROM o UNION ALL SELECT 'sources', sources FROM o UNION ALL SELECT 'mean_chars', mean_chars FROM o UNION ALL SELECT 'median_chars', median_chars FROM o UNION ALL SELECT 'kilo_chars', kilo_chars FROM o)""")
def overview_table(spark, sf):
    n = F.col("n_chars")
    m = {"documents": F.count("*"), "sources": F.count_distinct("source"), "mean_chars": F.avg(n), "median_chars": F.median(n), "kilo_chars": F.sum(n) / 1000}
    return R.overview(B.table(spark, sf, "documents"), m).withColumn("value", F.round("value", 4))


@query("SELECT d.lang, round(avg(CAST(l.doc_id IS NOT NULL AS INTEGER)), 6) AS labelled, round(avg(CAST(n_chars >= 1000 AS INTEGER)), 6) AS long_text, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
def coverage(spark, sf):
    l = B.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))  # noqa: E741
    d = B.table(spark, sf, "documents").join(l, "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.avg(F.col("has").isNotNull().cast("int")), 6).alias("labelled"), F.round(F.avg((F.col("n_chars") >= 1000).cast("int")), 6).alias("long_text"), F.count("*").alias("n"))


@query(f"""WITH {_EDGES_SQL}, v AS (SELECT round(transition_score, 6) AS s FROM edges), b AS (SELECT CAST(least(floor((s - 0.0) / (1.0 / 24)), 23) AS INTEGER) AS bin, count(*) AS n FROM v WHERE s BETWEEN 0 AND 1 GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, round((range + 0.5) * (1.0 / 24), 4) AS x, round(range * (1.0 / 24), 4) AS lo, coalesce(n, 0) AS n FROM range(24) LEFT JOIN b ON bin = range""")
def score_histogram(spark, sf):
    return R.histogram(edges(spark, sf).select(F.round("transition_score", 6).alias("s")), F.col("s"), 24, 0.0, 1.0)


@query("""WITH b AS (SELECT CAST(CASE WHEN l_quantity = 40 THEN 19 ELSE floor(l_quantity / 2.0) END AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 40 GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, CAST((range + 0.5) * 2 AS DOUBLE) AS x, CAST(range * 2 AS DOUBLE) AS lo, coalesce(n, 0) AS n FROM range(20) LEFT JOIN b ON bin = range""")
def histogram_bins(spark, sf):
    return R.histogram(B.table(spark, sf, "lineitem"), F.col("l_quantity"), 20, 0.0, 40.0)


@query("SELECT n AS chain_length, count(*) AS chains, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY n")
def chain_length_hist(spark, sf):
    from pyspark.sql import Window

    n = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("chain_length"))
    h = n.groupBy("chain_length").agg(F.count("*").alias("chains"))
    return h.withColumn("share", F.round(F.col("chains") / F.sum("chains").over(Window.partitionBy()), 6))


@query(f"""WITH {_EDGES_SQL}, e AS (SELECT s.speed || '/' || s.vocals AS src, t.speed || '/' || t.vocals AS tgt FROM edges JOIN clips s ON s.clip_id = source JOIN clips t ON t.clip_id = target),
top AS (SELECT c FROM (SELECT src AS c FROM e UNION ALL SELECT tgt FROM e) GROUP BY c ORDER BY count(*) DESC, c LIMIT 6), n AS (SELECT src, tgt, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT a.c AS src, b.c AS tgt, coalesce(n, 0) AS n FROM top a CROSS JOIN top b LEFT JOIN n ON n.src = a.c AND n.tgt = b.c)
SELECT src, tgt, n, round(CASE WHEN sum(n) OVER (PARTITION BY src) > 0 THEN n / sum(n) OVER (PARTITION BY src) ELSE 0 END, 6) AS share FROM f""")
def transition_matrix(spark, sf):
    c = B.clips(spark, sf).select("clip_id", F.concat_ws("/", "speed", "vocals").alias("k"))
    e = edges(spark, sf).select("source", "target").join(c.select(F.col("clip_id").alias("source"), F.col("k").alias("src")), "source").join(c.select(F.col("clip_id").alias("target"), F.col("k").alias("tgt")), "target")
    return R.transition_matrix(e, "src", "tgt", 6).withColumn("share", F.round("share", 6))


_PTAGS = "list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))"


@query(f"""WITH t AS (SELECT p_partkey, {_PTAGS} AS i FROM part), e AS (SELECT p_partkey, unnest(i) AS item FROM t), top AS (SELECT item FROM e GROUP BY item ORDER BY count(*) DESC, item LIMIT 8),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM e x JOIN e y ON x.p_partkey = y.p_partkey AND x.item <> y.item GROUP BY ALL)
SELECT s.item AS a, t.item AS b, coalesce(n, 0) AS n FROM top s CROSS JOIN top t LEFT JOIN p ON p.a = s.item AND p.b = t.item""")
def axis_cooccurrence(spark, sf):
    p = B.table(spark, sf, "part").select(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("i"))
    return R.cooccurrence(p, "i", 8)


@query("""WITH d AS (SELECT DISTINCT event_type AS a, user_id AS e FROM events WHERE user_id % 7 <> length(event_type)), s AS (SELECT a, count(*) AS size FROM d GROUP BY a),
p AS (SELECT x.a, y.a AS b, count(*) AS shared FROM d x JOIN d y USING (e) GROUP BY ALL) SELECT x.a, y.a AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / x.size, 6) AS share FROM s x CROSS JOIN s y LEFT JOIN p ON p.a = x.a AND p.b = y.a""")
def leakage_matrix(spark, sf):
    e = B.table(spark, sf, "events").where(F.pmod("user_id", F.lit(7)) != F.length("event_type"))
    return R.leakage(e, "event_type", "user_id").withColumn("share", F.round("share", 6))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM c)
SELECT CASE WHEN r <= 8 THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_other_fold(spark, sf):
    return R.top_other(B.table(spark, sf, "part"), "p_brand", 8)


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS word FROM documents) WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 40""")
def word_frequency(spark, sf):
    return R.word_frequency(B.table(spark, sf, "documents"), "text", X.STOPWORDS)


@query("SELECT lang, median(n_chars) AS median_chars, round(quantile_cont(n_chars, 0.9), 4) AS p90 FROM documents GROUP BY lang")
def medians(spark, sf):
    return B.table(spark, sf, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"), F.round(F.percentile("n_chars", F.lit(0.9)), 4).alias("p90"))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def normalised_counts(spark, sf):
    return R.shares(B.table(spark, sf, "documents"), ["lang"], "source").withColumn("share", F.round("share", 6))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag")
def explode_counts(spark, sf):
    return R.explode_counts(B.table(spark, sf, "part"), F.split("p_name", " "), "tag")


@query("SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'pending' ELSE 'other' END AS status FROM orders) GROUP BY status")
def status_counters(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "pending").otherwise("other")
    return B.table(spark, sf, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS variants, (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS merged, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS pending")
def merged_pending(spark, sf):
    l = B.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("m")).distinct()  # noqa: E741
    d = B.table(spark, sf, "documents").join(l, "doc_id", "left")
    return d.agg(F.count("*").alias("variants"), F.count("m").alias("merged"), F.count_if(F.col("m").isNull()).alias("pending"))


@query("""SELECT conv_id, string_agg(turn || '=' || role, ',' ORDER BY turn) AS roles, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id""")
def group_to_array(spark, sf):
    c = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"), F.count_distinct("role").alias("n_roles"))
    return c.select("conv_id", F.array_join(F.transform("s", lambda x: F.concat(x["turn"].cast("string"), F.lit("="), x["role"])), ",").alias("roles"), "n_roles")


@query("SELECT round(c_acctbal / 10000, 4) AS x, CAST(round(c_acctbal / 10000 * 32767) AS SMALLINT) AS x16, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment_id, c_custkey FROM customer")
def compact_export(spark, sf):
    """Coordinates as 16-bit integers and a dictionary-coded column."""
    c = B.table(spark, sf, "customer")
    from pyspark.sql import Window

    names = c.select("c_mktsegment").distinct().withColumn("segment_id", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)
    x = F.col("c_acctbal") / 10000
    return c.join(F.broadcast(names), "c_mktsegment").select(F.round(x, 4).alias("x"), F.round(x * 32767).cast("short").alias("x16"), F.col("segment_id").cast("long").alias("segment_id"), "c_custkey")


@query("""SELECT o_orderpriority, count(*) FILTER (o_totalprice < 100000) AS missing_axis, count(*) FILTER (o_orderstatus = 'P') AS no_instruction, round(min(o_totalprice), 4) AS floor_score FROM orders GROUP BY 1 HAVING min(o_totalprice) >= 800""")
def quality_inspection(spark, sf):
    g = B.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") < 100000).alias("missing_axis"), F.count_if(F.col("o_orderstatus") == "P").alias("no_instruction"), F.round(F.min("o_totalprice"), 4).alias("floor_score"))
    return g.where("floor_score >= 800")
