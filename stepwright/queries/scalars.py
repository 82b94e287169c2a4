"""String, JSON, path and label functions (inventory 2.2) over documents, events, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import labels as L
from stepwright.functions import text as X
from stepwright.queries.registry import query

_J = lambda c: F.array_join(c, "|")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || '  ' || p_name), '[^a-z0-9\\-\\s]', '', 'g'), '\\s+', ' ', 'g')) AS tag FROM part")
def tag_normalise(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", X.normalise_tag(F.concat("p_brand", F.lit("  "), "p_name")).alias("tag"))


@query(f"""SELECT doc_id, c AS caption, trim(regexp_replace(c, '^[.,;:!?"''()\\[\\]{{}}]+|[.,;:!?"''()\\[\\]{{}}]+$', '', 'g'), ' ') AS bare
FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM documents)""")
def caption_normalise(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.normalise_caption(F.col("text")).alias("caption"), X.normalise_caption(F.col("text"), True).alias("bare"))


@query("""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?') AS t FROM documents)""")
def tokens(spark, sf):
    t = X.tokens(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), _J(t).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t)) AS t FROM documents)""")
def content_tokens(spark, sf):
    t = X.content_tokens(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), _J(t).alias("tokens"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS INTEGER) AS words,
CAST(len(regexp_extract_all(text, '[0-9A-Za-z][-0-9A-Za-z_''’]*')) AS INTEGER) AS long_words,
array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') AS phrase FROM documents""")
def word_counts(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.word_count(F.col("text"), X.WORD_LONG).alias("long_words"), X.phrase(F.col("text")).alias("phrase"))


_DEDUP = "list_filter({l}, lambda x, i: x <> '' AND list_position({l}, x) = i)"
_PHRASES_SQL = """list_transform(list_transform(regexp_split_to_array(lower({c}), '[,:;.!?]|\\s+-\\s+|\\s+and\\s+|\\s+with\\s+'),
  lambda p: regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^[ ''"()\\[\\]{{}}]+|[ ''"()\\[\\]{{}}]+$', '', 'g')), lambda p: array_to_string(string_split(p, ' ')[1:8], ' '))"""


@query(f"""SELECT doc_id, array_to_string({_DEDUP.format(l='ps')}, '|') AS phrases, CAST(len({_DEDUP.format(l='ps')}) AS INTEGER) AS n
FROM (SELECT doc_id, {_PHRASES_SQL.format(c='text')} AS ps FROM documents)""")
def phrases(spark, sf):
    p = X.phrases(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", _J(p).alias("phrases"), F.size(p).alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE coalesce(nullif(regexp_extract(left(text, 120), '(?s)^(.*) ', 1), ''), left(text, 120)) END AS clipped FROM documents""")
def clip_text(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 120).alias("clipped"))


@query(f"""SELECT doc_id, array_to_string(d, '|') AS distinct_words, array_to_string(d[1:5], '|') AS bounded
FROM (SELECT doc_id, {_DEDUP.format(l='w')} AS d FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""")
def dedupe_lists(spark, sf):
    w = F.split(F.col("text"), " ")
    return B.table(spark, sf, "documents").select("doc_id", _J(X.dedupe(w)).alias("distinct_words"), _J(X.dedupe(w, 5)).alias("bounded"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN '' WHEN event_id % 5 = 2 THEN '' ELSE event_type || '|' || user_id END AS items,
json_extract_string(props, '$.k') AS k FROM events""")
def json_list_parse(spark, sf):
    e = B.table(spark, sf, "events")
    kind = F.pmod("event_id", F.lit(5))
    whole = F.concat(F.lit('[" '), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('", "", null]'))
    raw = F.when(kind == 0, "").when(kind == 1, '["a", "b').when(kind == 2, F.col("props")).otherwise(whole)
    return e.select("event_id", _J(X.parse_json_list(raw)).alias("items"), F.try_element_at(X.parse_json_object(F.col("props")), F.lit("k")).alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS object FROM events""")
def json_object_extract(spark, sf):
    kind = F.pmod("event_id", F.lit(4))
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(kind == 2, F.col("props")).otherwise("no {object here")
    return B.table(spark, sf, "events").select("event_id", X.extract_json_object(raw).alias("object"))


@query("""SELECT o_orderkey, try_cast(o_totalprice AS DOUBLE) AS ms, round(o_totalprice / 1000, 3) AS seconds FROM orders""")
def track_seconds(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("ms"), L.seconds(F.col("o_totalprice")).alias("seconds"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(CASE WHEN p_partkey % 3 = 0 THEN string_split(p_type || ', ,a', ',') ELSE w END, lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM p""")
def tag_sets(spark, sf):
    """Tags from a JSON list, or from a comma-separated column where that is empty or no JSON."""
    listed = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, "[]").otherwise("no list")).otherwise(F.to_json(F.split("p_name", " ")))
    return B.table(spark, sf, "part").select("p_partkey", _J(X.tag_set(listed, F.concat("p_type", F.lit(", ,a")))).alias("tags"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, regexp_replace(printf('%.3f', l_quantity + l_tax), '\\.?0+$', '') AS start_key,
l_orderkey || '::' || regexp_replace(printf('%.3f', l_quantity), '\\.?0+$', '') || '-' || regexp_replace(printf('%.3f', l_quantity + l_tax), '\\.?0+$', '') || '::' || l_linenumber AS clip_id FROM lineitem""")
def clip_ids(spark, sf):
    q, t = F.col("l_quantity"), F.col("l_quantity") + F.col("l_tax")
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", L.time_key(t).alias("start_key"), L.clip_key(F.col("l_orderkey"), q, t, F.col("l_linenumber")).alias("clip_id"))


@query("""SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 80) || '__' || substr(sha1(url), 1, 12) AS stem FROM pages""")
def file_stems(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", L.file_stem(F.col("url")).alias("stem"))


@query("""SELECT p_partkey, 'a/' || p_partkey || '.ogg' AS template, lpad(right(CAST(p_partkey AS VARCHAR), 2), 2, '0') || '/' || p_partkey || '.mp3' AS shard FROM part""")
def audio_paths(spark, sf):
    k = F.col("p_partkey").cast("string")
    return B.table(spark, sf, "part").select("p_partkey", L.audio_path(k, "template", template="a/{track_id}.ogg").alias("template"), L.audio_path(k, "shard").alias("shard"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_tax > l_discount THEN round(l_tax - l_discount, 6) END AS duration,
floor(try_cast(CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE ' ' || CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) + 0.5) / 1000 AS seconds FROM lineitem""")
def time_parsing(spark, sf):
    raw = F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("string")))
    d = F.round(L.duration(F.col("l_discount"), F.col("l_tax")), 6)
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", d.alias("duration"), F.round(X.parse_double(raw) / 1000, 3).alias("seconds"))


_GENRE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{w.replace('&', '[&]')}') THEN '{g}'" for g, w in L.GENRES) + " ELSE 'Other' END"


@query(f"SELECT doc_id, {_GENRE_SQL} AS genre FROM (SELECT doc_id, array_to_string(string_split(lower(text), ' '), '|') AS line FROM documents)")
def genre_map(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", L.genre(F.split(F.lower(F.col("text")), " ")).alias("genre"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'eco') THEN 'x' ELSE 'y' END AS probe,
CASE WHEN contains(lower(p_name), 'instrumental') THEN 'instrumental' WHEN p_size % 2 = 0 THEN 'vocal' ELSE '' END AS vocals FROM part""")
def vocal_label(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.when(F.contains(F.lower("p_type"), F.lit("eco")), "x").otherwise("y").alias("probe"), L.vocal_label(F.split("p_name", " "), F.pmod("p_size", F.lit(2)) == 0).alias("vocals"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size * 4 < 90 THEN 'slow' WHEN p_size * 4 > 140 THEN 'fast' ELSE 'medium' END AS speed FROM part""")
def speed_label(spark, sf):
    bpm = F.when(F.pmod("p_size", F.lit(7)) == 0, "?").otherwise((F.col("p_size") * 4).cast("string"))
    return B.table(spark, sf, "part").select("p_partkey", L.tempo_label(bpm).alias("speed"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 6 <= 1 THEN 'easy' WHEN o_custkey % 6 <= 3 THEN 'medium' ELSE 'hard' END AS hardness,
CASE WHEN o_totalprice / 500000 < 0.75 THEN 'low' WHEN o_totalprice / 500000 < 0.85 THEN 'mid' ELSE 'high' END AS score_band,
CASE WHEN o_custkey % 6 <= 1 THEN 'early' WHEN o_custkey % 6 <= 3 THEN 'middle' ELSE 'late' END AS turn_band,
CASE WHEN o_custkey % 6 <= 1 THEN 'single' WHEN o_custkey % 6 < 5 THEN 'partial' ELSE 'full5' END AS variant_band,
CASE WHEN o_custkey % 6 <= 0 THEN 'none' WHEN o_custkey % 6 = 1 THEN 'single_axis' ELSE 'multi_axis' END AS axis_band,
round(greatest(0, least(1, o_totalprice / 300000 - 0.2)), 9) AS clipped FROM orders""")
def hardness_band(spark, sf):
    n, s = F.pmod("o_custkey", F.lit(6)), F.col("o_totalprice") / 500000
    return B.table(spark, sf, "orders").select("o_orderkey", L.hardness(n).alias("hardness"), L.score_band(s).alias("score_band"), L.turn_band(n).alias("turn_band"), L.variant_band(n).alias("variant_band"), L.axis_count_band(n).alias("axis_band"), F.round(L.clip01(F.col("o_totalprice") / 300000 - 0.2), 9).alias("clipped"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i)\\b(please|could\\s+you|can\\s+you|i[''’]d\\s+like|i\\s+would\\s+like|i\\s+want)\\b') THEN 'non_imperative_request_frame'
WHEN n > m THEN 'too_wordy_' || n || '_words' END AS error
FROM (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'Please ' || text ELSE text END AS t, len(regexp_extract_all(CASE WHEN turn = 1 THEN 'Please ' || text ELSE text END, '[0-9A-Za-z][-0-9A-Za-z_''’]*')) AS n,
CASE turn % 4 WHEN 0 THEN 7 WHEN 1 THEN 12 WHEN 2 THEN 18 END AS m FROM conversations)""")
def style_lint(spark, sf):
    t = F.when(F.col("turn") == 1, F.concat(F.lit("Please "), "text")).otherwise(F.col("text"))
    v = F.element_at(F.array(F.lit("short"), F.lit(" Medium"), F.lit("LONG"), F.lit("none")), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", L.style_error(t, v).alias("error"))


_CUES = "|".join(L.RELATIVE_CUES)


@query(f"""SELECT conv_id, turn, regexp_matches(lower(text), '{_CUES}') AS relative,
CAST(len(list_filter(['the', 'and', 'Der', '', 'que'], lambda t: t <> '' AND contains(lower(text), t))) AS INTEGER) AS hits FROM conversations""")
def relative_cues(spark, sf):
    terms = F.array(*map(F.lit, ("the", "and", "Der", "", "que")))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", L.has_relative_cue(F.col("text")).alias("relative"), L.term_hits(F.col("text"), terms).alias("hits"))


@query("""SELECT event_id, CASE WHEN p IN ('bye', 'thank you', 'you') THEN 'exact_phrase' WHEN n > 0 AND n <= 2 AND last = 'you' THEN 'short_suffix' END AS reason
FROM (SELECT event_id, p, len(string_split(p, ' ')) AS n, string_split(p, ' ')[-1] AS last
      FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'thank you' WHEN 1 THEN event_type || ' you' WHEN 2 THEN event_type || ' for you' ELSE event_type END AS p FROM events))""")
def hallucination_filter(spark, sf):
    k = F.pmod("event_id", F.lit(4))
    t = F.when(k == 0, "Thank you!").when(k == 1, F.concat("event_type", F.lit(" YOU."))).when(k == 2, F.concat("event_type", F.lit(" for you"))).otherwise(F.col("event_type"))
    return B.table(spark, sf, "events").select("event_id", L.hallucination(t).alias("reason"))


_OPTIONS = ["signup", "view", "Purchase", "clicked"]
_SCALE = {"signup": 1, "view": 2, "Purchase": 4, "clicked": 5}


@query("""SELECT event_id, l AS label, CASE l WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'Purchase' THEN 4 WHEN 'clicked' THEN 5 END AS score
FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'signup' WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'Purchase' WHEN 'click' THEN 'clicked' END AS l FROM events)""")
def label_scores(spark, sf):
    label = L.coerce_label(F.col("event_type"), _OPTIONS)
    return B.table(spark, sf, "events").select("event_id", label.alias("label"), L.label_score(label, _SCALE).alias("score"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
regexp_replace(regexp_extract(url, '/([0-9]+)[^/0-9]*$', 1), '^0+', '') AS number,
nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    page = F.nullif(F.regexp_extract(u, "[?&]page=([^&#]*)", 1), F.lit(""))
    return B.table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"), page.alias("page"), F.regexp_replace(F.regexp_extract(u, "/([0-9]+)[^/0-9]*$", 1), "^0+", "").alias("number"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query("""SELECT p_partkey, upper(left(t, 1)) || lower(substr(t, 2)) AS label, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fk', n / 1e3) ELSE CAST(n AS VARCHAR) END AS count
FROM (SELECT p_partkey, trim(replace(lower(p_type) || '_' || p_name, '_', ' ')) AS t, p_partkey * 977 AS n FROM part)""")
def pretty_labels(spark, sf):
    n = F.col("p_partkey") * 977
    return B.table(spark, sf, "part").select("p_partkey", L.nice(F.concat(F.lower("p_type"), F.lit("_"), "p_name")).alias("label"), L.abbreviated(n).alias("count"))


@query("""SELECT event_id, sha1('7:' || event_type || ':' || user_id) AS digest, CASE WHEN contains(event_type, 'i') THEN 'x:y' ELSE event_type END AS term,
CASE WHEN contains(event_type, 'i') THEN 'y' ELSE event_type END AS value FROM events""")
def digests_and_terms(spark, sf):
    term = F.when(F.contains("event_type", F.lit("i")), "x:y").otherwise(F.col("event_type"))
    return B.table(spark, sf, "events").select("event_id", L.digest(F.lit(7), F.col("event_type"), F.col("user_id")).alias("digest"), term.alias("term"), X.term_value(F.concat(F.lit(" "), F.upper(term))).alias("value"))


@query("""SELECT p_partkey, array_to_string(list_filter(['energy', 'other', CASE WHEN p_size % 2 = 0 THEN 'vocal_style_or_gender' END], lambda x: x IS NOT NULL), '|') AS axes,
'rock|jazz' AS genres, 'drums' AS instruments FROM part""")
def axis_and_prefix_lists(spark, sf):
    raw = F.array(F.lit("Energy"), F.lit("vocals"), F.when(F.pmod("p_size", F.lit(2)) == 0, "vocal style-or gender").otherwise("energy"))
    tags = F.lit("genre---rock instrument---drums genre---jazz")
    return B.table(spark, sf, "part").select("p_partkey", _J(L.normalise_axes(raw)).alias("axes"), _J(X.prefixed(tags, "genre")).alias("genres"), _J(X.prefixed(tags, "instrument")).alias("instruments"))


@query("""SELECT t AS event_type, n, CASE WHEN n * 1.0 / m < 0.12 THEN 'rare' WHEN n * 1.0 / m < 0.35 THEN 'uncommon' WHEN n * 1.0 / m < 0.75 THEN 'common' ELSE 'very common' END AS usage
FROM (SELECT t, n, max(n) OVER () AS m FROM (SELECT event_type || (user_id % 3 * (event_id % 2)) AS t, count(*) AS n FROM events GROUP BY 1))""")
def axis_usage(spark, sf):
    t = F.concat("event_type", (F.pmod("user_id", F.lit(3)) * F.pmod("event_id", F.lit(2))).cast("string"))
    g = B.table(spark, sf, "events").groupBy(t.alias("event_type")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.max("n").alias("m")))).select("event_type", "n", L.usage_label(F.col("n"), F.col("m")).alias("usage"))


@query(f"""SELECT doc_id, coalesce(m, '') AS longest, coalesce(s[1], '') AS first, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), source) AS fallback,
lang || ' ' || source AS both FROM (SELECT doc_id, lang, source, s, list_filter(s, lambda x: length(x) = list_max(list_transform(s, lambda y: length(y))))[1] AS m
FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, ', '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents))""")
def primary_strings(spark, sf):
    s = X.split_on(F.col("text"), ", ")
    blank = F.when(F.pmod("doc_id", F.lit(3)) == 0, "  ").otherwise(F.col("lang"))
    return B.table(spark, sf, "documents").select("doc_id", X.primary(s).alias("longest"), X.primary(s, "first").alias("first"), X.first_non_empty(blank, F.col("source")).alias("fallback"), X.combined(F.col("lang"), F.col("source")).alias("both"))
