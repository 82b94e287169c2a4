"""Text search (inventory 2.14): benchmark texts as queries over documents, four neighbouring documents a track."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.operators import search as S
from stepwright.operators.keys import top_k
from stepwright.queries.registry import query
from stepwright.storage import written

_TRACKS_SQL = """r AS (SELECT doc_id // 4 AS track, list(trim(text) ORDER BY doc_id) AS p FROM documents GROUP BY 1),
u AS (SELECT track, list_filter(p, lambda x: x <> '') AS a FROM r),
tracks AS (SELECT track, lower(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ')) AS search_text FROM u),
words AS (SELECT DISTINCT track, unnest(regexp_extract_all(search_text, '[a-z0-9]+')) AS token FROM tracks),
q AS (SELECT item_id, lower(trim(text)) AS text FROM benchmark),
qt AS (SELECT item_id, text, list_distinct(regexp_extract_all(text, '[a-z0-9]+')) AS tokens FROM q)"""
_EXACT_SQL = "SELECT item_id, track, count(*) AS hits FROM (SELECT item_id, unnest(tokens) AS token FROM qt) JOIN words USING (token) GROUP BY ALL"


def _tracks(spark, sf):
    d = B.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("track"), "doc_id", "text")
    return S.roll_up(d, "track", "doc_id", ["text"])


def _queries(spark, sf):
    return S.query_tokens(B.table(spark, sf, "benchmark").select("item_id", "text"), "text")


@query(f"WITH {_TRACKS_SQL} SELECT t.track, CAST(length(search_text) AS INTEGER) AS n_chars, count(w.token) AS n_words FROM tracks t LEFT JOIN words w ON w.track = t.track GROUP BY ALL")
def track_rollup(spark, sf):
    return _tracks(spark, sf).select("track", F.length("search_text").alias("n_chars"), F.size("words").cast("long").alias("n_words"))


@query(f"WITH {_TRACKS_SQL} SELECT token, count(*) AS df, min(track) AS first_track FROM words GROUP BY token")
def inverted_index(spark, sf):
    return S.inverted_index(_tracks(spark, sf), "track").select("token", F.size("postings").cast("long").alias("df"), F.element_at("postings", 1).alias("first_track"))


@query(f"WITH {_TRACKS_SQL}, e AS ({_EXACT_SQL}) SELECT item_id, track, hits, 'exact' AS stage FROM e")
def search_candidates(spark, sf):
    """Each text has words that documents have, so the cascade ends at its first stage; the others are in search_misspelt."""
    tracks = written(_tracks(spark, sf), "tracks")
    return S.candidates(_queries(spark, sf), tracks, S.inverted_index(tracks, "track"), "item_id", "track")


@query(f"""WITH {_TRACKS_SQL}, e AS ({_EXACT_SQL}), s AS (
  SELECT item_id, track, CASE WHEN contains(search_text, text) THEN 4 + least(length(text) / 120.0, 1.0) ELSE 3 + hits / len(tokens) END AS score FROM e JOIN qt USING (item_id) JOIN tracks USING (track))
SELECT item_id, track, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, track) AS place FROM s WHERE score > 0) WHERE place <= 10""")
def search_scores(spark, sf):
    q, t = _queries(spark, sf), written(_tracks(spark, sf), "tracks")
    s = S.scores(S.candidates(q, t, S.inverted_index(t, "track"), "item_id", "track"), q, t, "item_id", "track").withColumn("score", F.round("score", 9)).where("score > 0")
    return top_k(s, ["item_id"], [F.col("score").desc(), F.col("track")], 10, "place").withColumn("score", F.round("score", 6))


@query()
def search_misspelt(spark, sf):
    """Scores of queries that no document has a word of: each text's longest word with a letter more, and the inside of it; compared with brute force in the tests."""
    longest = F.array_sort(F.col("tokens"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))[0]
    b = _queries(spark, sf).select("item_id", longest.alias("w")).where("w is not null")
    q = b.select(F.col("item_id") * 2, F.concat("w", F.lit("q"))).union(b.select(F.col("item_id") * 2 + 1, F.substring("w", F.lit(2), F.greatest(F.length("w") - 2, F.lit(1))))).toDF("query_id", "text")
    q, t = S.query_tokens(q, "text"), written(_tracks(spark, sf), "tracks")
    found = S.candidates(q, t, S.inverted_index(t, "track"), "query_id", "track").where("stage <> 'exact'")
    return S.scores(found, q, t, "query_id", "track").withColumn("score", F.round("score", 6)).where("score > 0")


@query()
def fuzzy_terms(spark, sf):
    """The three nearest catalogue words of each query token; compared with brute force in the tests."""
    index = S.inverted_index(_tracks(spark, sf), "track")
    return S.fuzzy_matches(_queries(spark, sf).select(F.explode("tokens").alias("token")), index).withColumn("ratio", F.round("ratio", 6))
