"""Filters, joins and rows by key (inventory 2.3, 2.4, 2.6) over the star schema, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import labels as L
from stepwright.functions import text as X
from stepwright.operators import ingest as I
from stepwright.operators import joins as N
from stepwright.operators import keys as K
from stepwright.queries.registry import query

_J = lambda c: F.array_join(c, "|")
_EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _events(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return B.table(spark, sf, "events").withColumn("k", k)


@query(f"SELECT user_id, event_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {_EV}) WHERE r = 1")
def latest_snapshot(spark, sf):
    return K.latest_by(_events(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "k")


@query(f"SELECT user_id, event_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {_EV}) WHERE r = 1")
def latest_snapshot_agg(spark, sf):
    return K.latest_values(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "k"])


@query(f"SELECT user_id, event_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {_EV}) WHERE r = 1")
def first_snapshot(spark, sf):
    return K.first_by(_events(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "k")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_rating(spark, sf):
    return K.latest_by(B.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ordinal) AS r
FROM (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ordinal FROM events)) WHERE r = 1""")
def caption_ordinals(spark, sf):
    return K.distinct_with_ordinal(B.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", "ordinal")


_REASON = "CASE WHEN trim(CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END) = '' THEN 'missing_caption' WHEN doc_id % 11 = 0 THEN 'missing_tags' WHEN source = 'src3' THEN 'audio_not_found' END"


def _reasoned(spark, sf):
    caption = F.when(F.pmod("doc_id", F.lit(7)) == 0, "  ").otherwise(F.col("text"))
    tags = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return B.table(spark, sf, "documents").withColumn("reason", I.drop_reason(caption, tags, F.col("source") != "src3", True, True, True))


@query(f"SELECT doc_id AS track_id, {_REASON} AS reason FROM documents WHERE {_REASON} IS NOT NULL")
def dropped_rows(spark, sf):
    return _reasoned(spark, sf).where("reason is not null").select(F.col("doc_id").alias("track_id"), "reason")


@query(f"""SELECT doc_id AS track_id, lang, source, user_events FROM (SELECT *, {_REASON} AS reason FROM documents) d
JOIN (SELECT user_id, count(*) AS user_events FROM events GROUP BY 1) e ON e.user_id = d.doc_id WHERE reason IS NULL""")
def ingest_manifest(spark, sf):
    e = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("user_events"))
    kept = _reasoned(spark, sf).where("reason is null").select(F.col("doc_id").alias("track_id"), "lang", "source")
    return N.captioned(kept, e, "track_id")


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_counters(spark, sf):
    return _reasoned(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_CJ = "SELECT d.doc_id, l.doc_id IS NOT NULL AND quality = 1 AS has_rewrite, CASE WHEN quality = 1 THEN 'q1:' || toxic ELSE '' END AS rewritten_lang, CASE WHEN quality = 1 THEN 'q1:' || toxic ELSE lang END AS lang FROM documents d {} JOIN labels l ON l.doc_id = d.doc_id {}"


def _rewrites(spark, sf):
    v = F.when(F.col("quality") == 1, F.concat(F.lit(" q1:"), "toxic")).otherwise(" ")
    return B.table(spark, sf, "labels").select("doc_id", v.alias("rewrite"))


@query(_CJ.format("LEFT", "").replace("l.doc_id IS NOT NULL AND quality = 1", "coalesce(quality = 1, false)"))
def caption_join(spark, sf):
    return N.with_rewrites(B.table(spark, sf, "documents").select("doc_id", "lang"), _rewrites(spark, sf), "doc_id", "rewrite", "lang", overwrite=True)


@query(_CJ.format("", "WHERE quality = 1").replace(", CASE WHEN quality = 1 THEN 'q1:' || toxic ELSE lang END AS lang", ", lang"))
def caption_join_inner(spark, sf):
    return N.with_rewrites(B.table(spark, sf, "documents").select("doc_id", "lang"), _rewrites(spark, sf), "doc_id", "rewrite", "lang", keep_unmatched=False)


@query("""SELECT coalesce(c.k, o.k, s.k) AS k, c_name, n_orders, s_name FROM (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 > 0) c
FULL JOIN (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) o ON c.k = o.k FULL JOIN (SELECT s_suppkey AS k, s_name FROM supplier) s ON s.k = coalesce(c.k, o.k)""")
def full_outer_metadata(spark, sf):
    c = B.table(spark, sf, "customer").where(F.pmod("c_custkey", F.lit(3)) > 0).select(F.col("c_custkey").alias("k"), "c_name")
    o = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return N.union_of_keys([c, o, s], "k")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_artifacts_anti(spark, sf):
    return N.pending(B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) INTERSECT SELECT doc_id, lang FROM documents WHERE source <> 'src1'")
def usable_semi(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "source")
    have = d.join(B.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")
    return have.intersect(d.where("source <> 'src1'").select("doc_id", "lang"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'ok' WHEN d.doc_id % 5 = 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def pending_status(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, "failed").otherwise("ok").alias("status"))
    return N.refresh_status(rows, B.table(spark, sf, "labels"), "doc_id", "status")


@query("""SELECT c_custkey, o_orderkey AS previous_o_orderkey, o_orderstatus AS previous_o_orderstatus FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1""")
def merge_previous_first(spark, sf):
    o = B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return N.merge_previous(B.table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""SELECT c_custkey, o_orderkey AS previous_o_orderkey FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1""")
def merge_previous_last(spark, sf):
    o = B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return N.merge_previous(B.table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"], first_wins=False)


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT s_suppkey FROM supplier)")
def referenced_manifest(spark, sf):
    o = B.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return N.referenced(B.table(spark, sf, "customer").select("c_custkey", "c_name"), [(o, "o_custkey"), (B.table(spark, sf, "supplier"), "s_suppkey")], "c_custkey")


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT c_custkey AS k, c_mktsegment AS v, 0 AS p FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM orders)) WHERE r = 1""")
def index_union(spark, sf):
    a = B.table(spark, sf, "customer").where(F.pmod("c_custkey", F.lit(2)) == 0).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return N.index_union(a, B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")), ["k"])


@query("""WITH g AS (SELECT CASE WHEN source = 'src2' THEN '__unknown__' ELSE source END AS g, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT g, n, coalesce(sum(n) OVER (ORDER BY sha1('13:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, sum(n) OVER () AS total FROM g),
t AS (SELECT *, pre < floor(total * 0.9) AS train, sum(CASE WHEN pre < floor(total * 0.9) THEN n ELSE 0 END) OVER () AS trained FROM o)
SELECT doc_id, CASE WHEN train THEN 'train' WHEN pre - trained < floor(total * 0.05) THEN 'val' ELSE 'test' END AS split
FROM documents JOIN t ON g = CASE WHEN source = 'src2' THEN '__unknown__' ELSE source END""")
def group_split(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.when(F.col("source") == "src2", "  ").otherwise(F.col("source")).alias("source"))
    return I.group_split(d, "source").select("doc_id", "split")


@query("SELECT label, CASE WHEN label IN ('dev', 'val') THEN 'validation' ELSE label END AS split, n FROM (SELECT ['dev', 'val', 'train'][CAST(user_id % 3 AS INTEGER) + 1] AS label, count(*) AS n FROM events GROUP BY 1)")
def split_aliases(spark, sf):
    label = F.element_at(F.array(F.lit("dev"), F.lit("val"), F.lit("train")), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    return B.table(spark, sf, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n")).select("label", I.canonical_split(F.concat(F.upper("label"), F.lit(" "))).alias("split"), "n")


_TAGS = "list_filter(string_split(p_name, ' '), lambda x: x <> '')"


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 7")
def tag_vocabulary_topn(spark, sf):
    p = B.table(spark, sf, "part").select(F.filter(F.split("p_name", " "), lambda x: x != "").alias("tags"))
    return I.vocabulary(p, "tags", 7)


@query(f"""WITH v AS (SELECT tag FROM (SELECT unnest({_TAGS}) AS tag FROM part) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 7)
SELECT p_partkey, lower(p_name) AS caption, CAST(length(p_name) AS INTEGER) AS caption_char_len, array_to_string(list_filter({_TAGS}, lambda x: list_contains(vs, x)), '|') AS tags,
CAST(len({_TAGS}) AS INTEGER) AS tag_count FROM part CROSS JOIN (SELECT list(tag) AS vs FROM v)""")
def structured_view(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", F.filter(F.split("p_name", " "), lambda x: x != "").alias("tags"))
    p = p.withColumn("tag_count", F.size("tags"))
    out = I.keep_vocabulary(p, "tags", I.vocabulary(p, "tags", 7))
    return out.select("p_partkey", X.normalise_caption(F.col("p_name")).alias("caption"), F.length("p_name").alias("caption_char_len"), _J("tags").alias("tags"), "tag_count")


@query("""SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'non_vocal' WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'filtered' WHEN doc_id % 5 = 2 THEN 'empty' ELSE 'ok' END AS status,
CASE WHEN lang IN ('en', 'fr') AND doc_id % 9 <> 0 AND doc_id % 5 NOT IN (1, 2) THEN source ELSE '' END AS lyrics,
CASE WHEN lang NOT IN ('en', 'fr') THEN '' WHEN doc_id % 9 = 0 THEN 'transcription_failed' WHEN doc_id % 5 = 1 THEN 'exact_phrase' ELSE '' END AS error,
lang IN ('en', 'fr') AND doc_id % 9 <> 0 AND doc_id % 5 <> 1 AS reusable FROM documents""")
def lyric_states(spark, sf):
    five = F.pmod("doc_id", F.lit(5))
    t = F.when(five == 1, "Thank you.").when(five == 2, " ").otherwise(F.col("source"))
    state = I.lyric_state(F.col("lang"), t, F.pmod("doc_id", F.lit(9)) == 0, ("en", "fr"))
    d = B.table(spark, sf, "documents").select("doc_id", "lang", t.alias("t"), state.alias("s"))
    return d.select("doc_id", "s.status", "s.lyrics", "s.error", I.reusable(F.col("s.status"), F.col("lang"), F.col("t"), ("en", "fr")).alias("reusable"))


@query("""SELECT conv_id, turn, CAST(length(t) AS INTEGER) AS n FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations) WHERE length(t) >= 40""")
def min_length_filter(spark, sf):
    n = F.length(F.trim("text"))
    return B.table(spark, sf, "conversations").where(n >= 40).select("conv_id", "turn", n.alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def row_limit_prefix(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(25)


@query("""SELECT page_id, line_no, path, title, artist, license FROM (
SELECT page_id, 1 AS line_no, 'p/' || page_id || '.mp3' AS path, 'T' || page_id AS title, 'A' || (page_id % 7) AS artist, ['CC-BY', 'CC0'][page_id % 2 + 1] AS license FROM pages)""")
def license_blocks(spark, sf):
    """Three-line blocks (path, title by artist from source: link, licence), read by position."""
    from stepwright.sources.readers import license_blocks as parse

    k = F.col("page_id").cast("string")
    one = F.concat_ws("\n", F.concat(F.lit("p/"), k, F.lit(".mp3")), F.concat(F.lit("T"), k, F.lit(" by A"), F.pmod("page_id", F.lit(7)).cast("string"), F.lit(" from the archive: http://x.example/"), k), F.when(F.pmod("page_id", F.lit(2)) == 0, "CC-BY").otherwise("CC0"))
    rows = B.table(spark, sf, "pages").select(F.col("page_id"), one.alias("content"))
    return parse(rows, "content", ["page_id"]).select("page_id", F.lit(1).alias("line_no"), "path", "title", "artist", "license")


@query("""SELECT split, CAST(count(*) AS BIGINT) AS n, count(DISTINCT artist_id) AS artists FROM (SELECT ['train', 'val', 'test'][label % 3 + 1] AS split, p_brand AS artist_id FROM embeddings JOIN part ON vec_id = p_partkey JOIN documents ON doc_id = vec_id) GROUP BY split""")
def clip_split_counts(spark, sf):
    return B.clips(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("artist_id").alias("artists"))


@query("""SELECT event_id, regexp_extract(f, '^(.*)__turn_(\\d+)__variant_(\\d+)__[0-9a-f]+\\.json$', 1) AS chain, CAST(regexp_extract(f, '__turn_(\\d+)__', 1) AS INTEGER) AS turn, CAST(regexp_extract(f, '__variant_(\\d+)__', 1) AS INTEGER) AS variant
FROM (SELECT event_id, 'c' || user_id || '__turn_' || (event_id % 6) || '__variant_' || (event_id % 5) || '__' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 12) || '.json' AS f FROM events)""")
def sidecar_names(spark, sf):
    from stepwright.sources.readers import sidecar_key

    e = F.col("event_id").cast("string")
    f = F.concat(F.lit("/d/c"), F.col("user_id").cast("string"), F.lit("__turn_"), F.pmod("event_id", F.lit(6)).cast("string"), F.lit("__variant_"), F.pmod("event_id", F.lit(5)).cast("string"), F.lit("__"), F.substring(F.sha1(e), 1, 12), F.lit(".json"))
    return B.table(spark, sf, "events").select("event_id", sidecar_key(f).alias("k")).select("event_id", "k.chain", "k.turn", "k.variant")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id || ' (' || source || ', ' || lang || ')' ELSE doc_id || ' (' || lang || ')' END AS line FROM documents""")
def detected_items(spark, sf):
    from stepwright.sources.writers import detected_lines

    return detected_lines(B.table(spark, sf, "documents"), F.col("doc_id"), [F.when(F.col("lang") == "en", F.col("source")).otherwise(" "), F.col("lang")]).select("doc_id", "line")
