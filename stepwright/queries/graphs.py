"""Neighbours, transitions, adjacency and walks (inventory 2.8, 2.9) over clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import arrays as A
from stepwright.operators import graph as G
from stepwright.operators import vectors as V
from stepwright.operators.keys import dense_index
from stepwright.queries.registry import query

K, RETAIN = 50, 10
_J = lambda c: F.array_join(c, "|")


def _knn_sql(k: int, least: str = "") -> str:
    return f"""{B.CLIPS_SQL}, pairs AS (
      SELECT a.clip_id AS source, b.clip_id AS target, round(list_dot_product(a.audio, b.audio), 9) AS sim
      FROM clips a JOIN clips b ON a.split = b.split AND a.clip_id <> b.clip_id AND a.track_id <> b.track_id),
    knn AS (SELECT * FROM (SELECT source, target, sim, CAST(row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS INTEGER) AS rank FROM pairs {least}) WHERE rank <= {k})"""


_DELTA = "CAST(len(list_filter(s.tags, lambda x: NOT list_contains(t.tags, x))) + len(list_filter(t.tags, lambda x: NOT list_contains(s.tags, x))) AS INTEGER)"
_EDGES_SQL = f"""{_knn_sql(K)}, e1 AS (
  SELECT source, target, sim AS audio_similarity, s.tags AS source_tags, t.tags AS target_tags, {_DELTA} AS tag_delta_size,
         round(list_dot_product(s.text_vec, t.text_vec), 9) AS text_similarity
  FROM knn JOIN clips s ON s.clip_id = source JOIN clips t ON t.clip_id = target),
e2 AS (SELECT *, round(0.5 * audio_similarity + 0.5 * text_similarity, 9) AS rerank_score FROM e1 WHERE tag_delta_size <= 6),
e3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY audio_similarity DESC, target) AS INTEGER) AS audio_rank,
              CAST(row_number() OVER (PARTITION BY source ORDER BY rerank_score DESC, target) AS INTEGER) AS rerank_rank FROM e2),
edges AS (SELECT *, greatest(0, least(1, 0.4 * greatest(0, least(1, audio_similarity)) + 0.4 * greatest(0, least(1, text_similarity)) + 0.2 * greatest(0, least(1, 1 - tag_delta_size / 6.0)))) AS transition_score,
                 CASE WHEN tag_delta_size <= 1 THEN 'easy' WHEN tag_delta_size <= 3 THEN 'medium' ELSE 'hard' END AS hardness
          FROM e3 WHERE rerank_rank <= {RETAIN})"""


def edges(spark, sf):
    """Scored transitions: each clip's best RETAIN same-split neighbours."""
    clips = B.clips(spark, sf)
    return G.transitions(V.rerank(V.knn_blocks(clips, K), clips, retain=RETAIN))


@query(f"""WITH {_EDGES_SQL} SELECT source, target, audio_rank, rerank_rank, round(audio_similarity, 6) AS audio_similarity, round(text_similarity, 6) AS text_similarity,
tag_delta_size, round(transition_score, 6) AS transition_score, round(1 - transition_score, 6) AS transition_cost, hardness,
CAST(len(list_filter(target_tags, lambda x: list_contains(source_tags, x))) AS INTEGER) AS tags_preserved_count,
array_to_string(list_sort(list_filter(target_tags, lambda x: NOT list_contains(source_tags, x))), '|') AS tags_added,
array_to_string(list_sort(list_filter(source_tags, lambda x: NOT list_contains(target_tags, x))), '|') AS tags_removed FROM edges""")
def transition_edges(spark, sf):
    e = edges(spark, sf)
    return e.select("source", "target", "audio_rank", "rerank_rank", F.round("audio_similarity", 6).alias("audio_similarity"), F.round("text_similarity", 6).alias("text_similarity"), "tag_delta_size", F.round("transition_score", 6).alias("transition_score"), F.round("transition_cost", 6).alias("transition_cost"), "hardness", "tags_preserved_count", _J("tags_added").alias("tags_added"), _J("tags_removed").alias("tags_removed"))


@query(f"WITH {_knn_sql(10)} SELECT source, target, round(sim, 6) AS sim, rank FROM knn")
def knn_topk(spark, sf):
    return V.knn_blocks(B.clips(spark, sf), 10).select("source", "target", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_knn_sql(10)} SELECT source, target, round(sim, 6) AS sim, rank FROM knn")
def knn_blocked(spark, sf):
    return V.knn_blocks(B.clips(spark, sf), 10, block_rows=128).select("source", "target", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_knn_sql(5, 'WHERE sim >= 0.3')} SELECT source, target, round(sim, 6) AS sim, rank FROM knn")
def knn_min_similarity(spark, sf):
    return V.knn_blocks(B.clips(spark, sf), 5, least=0.3).select("source", "target", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_EDGES_SQL} SELECT source, target, audio_rank, rerank_rank, round(rerank_score, 6) AS rerank_score FROM edges")
def knn_rerank(spark, sf):
    clips = B.clips(spark, sf)
    return V.rerank(V.knn_blocks(clips, K), clips, retain=RETAIN).select("source", "target", "audio_rank", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"WITH {B.CLIPS_SQL} SELECT clip_id, round(list_dot_product(audio, text_vec), 6) AS cross_similarity, CAST(len(audio) AS INTEGER) AS dim, round(sqrt(list_dot_product(audio, audio)), 6) AS length FROM clips")
def vector_norms(spark, sf):
    return B.clips(spark, sf).select("clip_id", F.round(A.dot(F.col("audio"), F.col("text_vec")), 6).alias("cross_similarity"), F.size("audio").alias("dim"), F.round(A.norm(F.col("audio")), 6).alias("length"))


@query("SELECT CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS n FROM embeddings")
def embedding_dim(spark, sf):
    return B.table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"))


@query(f"""WITH {_EDGES_SQL} SELECT clip_id AS node, coalesce(degree, 0) AS degree, CAST(coalesce(sum(coalesce(degree, 0)) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_at
FROM clips LEFT JOIN (SELECT source, count(*) AS degree FROM edges GROUP BY source) ON source = clip_id""")
def adjacency_csr(spark, sf):
    nodes = B.clips(spark, sf).select(F.col("clip_id").alias("node"))
    return G.csr_offsets(edges(spark, sf), nodes).withColumnRenamed("offset", "offset_at")


@query(f"""WITH {_EDGES_SQL} SELECT source % 16 AS shard, source, count(*) AS degree, string_agg(target || ':' || rerank_rank, ' ' ORDER BY rerank_rank) AS neighbours FROM edges GROUP BY source""")
def adjacency_shards(spark, sf):
    a = G.adjacency(edges(spark, sf))
    line = F.array_join(F.transform("neighbours", lambda n: F.concat(n["target"].cast("string"), F.lit(":"), n["rerank_rank"].cast("string"))), " ")
    return a.select(F.pmod("source", F.lit(16)).alias("shard"), "source", "degree", line.alias("neighbours"))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT source AS clip_id FROM edges")
def valid_seeds(spark, sf):
    return edges(spark, sf).select(F.col("source").alias("clip_id")).distinct()


@query(f"""WITH {B.CLIPS_SQL}, e AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem),
s AS (SELECT CASE WHEN e.source % 50 = 7 OR e.target % 50 = 7 THEN 'missing_node' WHEN a.clip_id IS NULL OR b.clip_id IS NULL THEN 'missing_clip'
      WHEN a.split <> b.split THEN 'cross_split' WHEN len(list_filter(a.tags, lambda x: NOT list_contains(b.tags, x))) + len(list_filter(b.tags, lambda x: NOT list_contains(a.tags, x))) > 4 THEN 'tag_delta' ELSE 'ok' END AS status
      FROM e LEFT JOIN clips a ON a.clip_id = e.source LEFT JOIN clips b ON b.clip_id = e.target)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def edge_filter_counts(spark, sf):
    e = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    ids = e.select(F.col("source").alias("node")).union(e.select("target")).distinct().where(F.pmod("node", F.lit(50)) != 7)
    return G.edge_status(e, ids.withColumn("clip_id", F.col("node")), B.clips(spark, sf).select("clip_id", "split", "tags"), 4).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS row_idx FROM orders")
def dense_row_index(spark, sf):
    return dense_index(B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_idx")


_U = "CAST('0x' || substr(sha1({}), 1, 13) AS BIGINT) / 4503599627370496.0"


def _walk_sql(seed: int = 13) -> str:
    u = lambda *k: _U.format(f"'{seed}:' || " + " || ':' || ".join(k))
    key = f"-ln(greatest({u('w.chain_id', 'w.turn + 1', 'e.target')}, 1e-300)) / greatest(e.transition_score, 1e-12)"
    return f"""WITH RECURSIVE {_EDGES_SQL}, seeds AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS k FROM (SELECT DISTINCT source AS clip_id FROM edges)),
    ids AS (SELECT row_number() OVER () - 1 AS chain_id FROM clips),
    begun AS (SELECT chain_id, greatest(1, least(6, CAST(round(exp(0.7 + 0.75 * sqrt(-2 * ln(greatest({u("'a'", 'chain_id')}, 1e-300))) * cos(2 * pi() * {u("'b'", 'chain_id')}))) AS INTEGER))) AS length,
              CAST(floor({u("'seed'", 'chain_id')} * (SELECT count(*) FROM seeds)) AS BIGINT) AS k FROM ids),
    ways AS (SELECT e.source, e.target, e.transition_score, c.track_id AS target_track FROM edges e JOIN clips c ON c.clip_id = e.target),
    walk AS (
      SELECT b.chain_id, 0 AS turn, b.length, CAST(NULL AS BIGINT) AS source, s.clip_id AS target, CAST(NULL AS DOUBLE) AS transition_score, [s.clip_id] AS seen, [c.track_id] AS tracks
      FROM begun b JOIN seeds s ON s.k = b.k JOIN clips c ON c.clip_id = s.clip_id
      UNION ALL
      SELECT chain_id, turn, length, source, target, transition_score, seen, tracks FROM (
        SELECT w.chain_id, w.turn + 1 AS turn, w.length, e.source, e.target, e.transition_score, list_append(w.seen, e.target) AS seen, list_append(w.tracks, e.target_track) AS tracks,
               row_number() OVER (PARTITION BY w.chain_id ORDER BY {key}, e.target) AS r
        FROM walk w JOIN ways e ON e.source = w.target
        WHERE w.turn < w.length AND NOT list_contains(w.seen, e.target) AND NOT list_contains(w.tracks, e.target_track)) WHERE r = 1)
    SELECT chain_id, CAST(turn AS INTEGER) AS turn, source, target, round(transition_score, 6) AS transition_score FROM walk WHERE turn > 0"""


@query(_walk_sql())
def random_walk_chains(spark, sf):
    """As many walks as there are clips."""
    clips = B.clips(spark, sf)
    return G.walks(edges(spark, sf), clips, clips.count()).withColumn("transition_score", F.round("transition_score", 6))


@query()
def pca_projection(spark, sf):
    """Clips on the first three principal components of their audio vectors, on the unit sphere and as 16-bit integers."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    clips = B.clips(spark, sf).select("clip_id", array_to_vector("audio").alias("v"))
    model = PCA(k=3, inputCol="v", outputCol="p").fit(clips)
    unit = model.transform(clips).select("clip_id", A.unit(vector_to_array("p")).alias("p"))
    return unit.select("clip_id", *(F.round(F.element_at("p", k + 1), 6).alias(n) for k, n in enumerate("xyz")), *(F.round(F.element_at("p", k + 1) * 32767).cast("short").alias(f"{n}16") for k, n in enumerate("xyz")))
