"""Records, views, pooling and counters (inventory 2.3, 2.8, 2.9, 2.10) over the star schema, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import arrays as A
from stepwright.functions import text as X
from stepwright.operators import deltas as D
from stepwright.operators import ingest as I
from stepwright.operators import keys as K
from stepwright.queries.registry import query


@query("""SELECT p_partkey, trim(p_name) AS title, p_brand AS artist, '' AS license_url, CAST(p_retailprice AS VARCHAR) AS duration,
array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS tags
FROM (SELECT *, list_append(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lower(p_type)) AS w FROM part)""")
def track_records(spark, sf):
    p = B.table(spark, sf, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("string"))
    tags = I.tag_groups(F.split("p_name", " "), F.array(F.lower("p_type")), F.lit(None).cast("array<string>"))
    fields = {"title": "p_name", "artist": "p_brand", "license_url": "license", "duration": "p_retailprice"}
    return I.mapped(p, fields, tags, ["p_partkey"]).withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT doc_id, '{' || array_to_string(list_filter(['"language":"' || lang || '"', CASE WHEN doc_id % 3 > 0 THEN '"source":"' || source || '"' END, '"chars":"' || n_chars || '"'], lambda x: x IS NOT NULL), ',') || '}' AS view FROM documents""")
def metadata_views(spark, sf):
    blank = F.when(F.pmod("doc_id", F.lit(3)) == 0, "  ").otherwise(F.col("source"))
    return B.table(spark, sf, "documents").select("doc_id", I.snapshot({"language": F.col("lang"), "source": blank, "title": F.lit(None).cast("string"), "chars": F.col("n_chars")}).alias("view"))


_KEPT = "list_filter([1, 2, 3, 4], lambda k: k <= label % 5)"
_POOL = f"list_transform(generate_series(1, 16), lambda j: list_sum(list_transform({_KEPT}, lambda k: CAST(embedding[(k - 1) * 16 + j] AS DOUBLE))) / len({_KEPT}))"
_UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-12))"


@query(f"""SELECT vec_id, CASE WHEN label % 5 > 0 THEN round(u[1], 6) END AS first, CASE WHEN label % 5 > 0 THEN round(u[8], 6) END AS last, CASE WHEN label % 5 > 0 THEN CAST(len(u) AS INTEGER) END AS dim
FROM (SELECT vec_id, label, {_UNIT.format(v='t')} AS u FROM (SELECT vec_id, label, ({_UNIT.format(v='p')})[1:8] AS t FROM (SELECT vec_id, label, {_POOL} AS p FROM embeddings)))""")
def mean_pooled(spark, sf):
    """Each vector is read as four tokens of 16 values, of which the first label % 5 count."""
    e = B.table(spark, sf, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, F.lit(16)))
    mask = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (k <= F.pmod("label", F.lit(5))).cast("int"))
    u = A.mean_pool(tokens, mask, 8)
    return e.select("vec_id", F.round(F.try_element_at(u, F.lit(1)), 6).alias("first"), F.round(F.try_element_at(u, F.lit(8)), 6).alias("last"), F.when(u.isNotNull(), F.size(u)).alias("dim"))


@query(f"""WITH {B.TURNS_SQL}, p AS (SELECT role, CASE WHEN turn % 4 = 1 THEN '' ELSE coalesce(previous, '') END AS s, CASE WHEN turn % 4 = 2 THEN '' ELSE text END AS t FROM turns)
SELECT role, count(*) FILTER (s <> '') AS with_source, count(*) FILTER (t <> '') AS with_target, count(*) FILTER (s <> '' AND t <> '') AS with_both, count(*) FILTER (s <> '' AND t <> '' AND s <> t) AS changed,
count(*) FILTER (s = '' AND t <> '') AS added, count(*) FILTER (s <> '' AND t = '') AS removed FROM p GROUP BY role""")
def lyric_changes(spark, sf):
    s = F.when(F.pmod("turn", F.lit(4)) == 1, "").otherwise(F.col("previous"))
    t = F.when(F.pmod("turn", F.lit(4)) == 2, "").otherwise(F.col("text"))
    return B.turns(spark, sf).groupBy("role").agg(*(v.alias(k) for k, v in I.text_changes(s, t).items()))


@query("""SELECT event_id, CAST(user_id AS INTEGER) AS target, CASE WHEN event_id % 7 > 0 THEN round(value, 6) END AS score, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS delta_size FROM events""")
def edge_typing(spark, sf):
    """Rows of strings as numbers, and a JSON cell as a struct; what does not parse is null."""
    raw = B.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("target"), F.when(F.pmod("event_id", F.lit(7)) == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("score"), F.when(F.pmod("event_id", F.lit(5)) == 0, "{broken").otherwise(F.col("props")).alias("delta"))
    return raw.select("event_id", X.strip(F.col("target")).try_cast("int").alias("target"), F.round(X.parse_double(F.col("score")), 6).alias("score"), F.from_json("delta", "k int")["k"].alias("delta_size"))


@query(f"""WITH {B.TURNS_SQL} SELECT chain_id, turn, CASE WHEN turn % 3 = 0 THEN 'old source' ELSE coalesce(previous, '') END AS source, CASE WHEN turn % 3 = 0 THEN 'old target' ELSE text END AS target,
CASE WHEN turn % 2 = 0 THEN 'recorded' WHEN turn % 3 = 0 THEN 'alias' ELSE 'derived' END AS edit FROM (SELECT chain_id, turn, trim(previous) AS previous, trim(text) AS text FROM turns)""")
def delta_refresh(spark, sf):
    """Texts of a delta, taken from the manifest where it has any; and the first of three places of the edit."""
    away = F.pmod("turn", F.lit(3)) == 0
    now = lambda c: F.when(~away, F.col(c))
    fresh = D.refreshed(F.lit("old source"), F.lit("old target"), now("previous"), now("text"))
    edit = D.fallback_delta(F.when(F.pmod("turn", F.lit(2)) == 0, F.struct(F.lit("recorded").alias("e"))), F.when(away, F.struct(F.lit("alias").alias("e"))), F.struct(F.lit("derived").alias("e")))
    return B.turns(spark, sf).select("chain_id", "turn", fresh["source"].alias("source"), fresh["target"].alias("target"), edit["e"].alias("edit"))


@query("""SELECT conv_id AS chain_id, count(*) AS steps, string_agg(turn || ':' || coalesce(p_name, '-'), ' ' ORDER BY turn) AS manifest FROM conversations LEFT JOIN part ON p_partkey = conv_id * 10 + turn WHERE conv_id % 4 = 0 GROUP BY conv_id""")
def frozen_sidecar(spark, sf):
    """Assigned chains with their steps and the manifest rows of these steps in one document each."""
    from stepwright.sources.writers import sidecar

    c = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("chain_id"), "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("clip"))
    assigned = c.select("chain_id").distinct().where(F.pmod("chain_id", F.lit(4)) == 0)
    manifest = B.table(spark, sf, "part").select(F.col("p_partkey").alias("clip_id"), "p_name")
    d = sidecar(assigned, c.select("turn", "chain_id", "clip").select("chain_id", "turn", "clip"), manifest, ["chain_id"], "clip")
    steps = F.array_sort("steps", lambda a, b: (a["turn"] - b["turn"]).cast("int"))
    return d.select("chain_id", F.size("steps").cast("long").alias("steps"), F.array_join(F.transform(steps, lambda s: F.concat(s["turn"].cast("string"), F.lit(":"), F.coalesce(s["p_name"], F.lit("-")))), " ").alias("manifest"))


@query("SELECT l_partkey AS clip, max(l_discount) AS best, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_partkey")
def candidate_floor(spark, sf):
    return B.table(spark, sf, "lineitem").where(F.col("l_discount") >= 0.05).groupBy(F.col("l_partkey").alias("clip")).agg(F.max("l_discount").alias("best"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS kept FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def first_of_each(spark, sf):
    return K.first_by(B.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("kept"))
