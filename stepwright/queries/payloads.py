"""Deltas, payloads, typed items and prechecks (inventory 2.10, 2.11) over conversations and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.functions import arrays as A
from stepwright.functions import text as X
from stepwright.operators import deltas as D
from stepwright.operators import joins as N
from stepwright.queries.graphs import _EDGES_SQL, edges
from stepwright.queries.registry import query
from stepwright.queries.scalars import _DEDUP, _PHRASES_SQL, _STOP

_J = lambda c: F.array_join(c, "|")
_EXCEPT = "list_filter({a}, lambda x: NOT list_contains({b}, x))"
_BOTH = "list_filter({a}, lambda x: list_contains({b}, x))"


def _facet_sql(name: str, part: str) -> str:
    s, t = f"s_{name}", f"t_{name}"
    cond = {"persistent": f"{s} <> '' AND {s} = {t}", "added": f"NOT ({s} <> '' AND {s} = {t}) AND {t} <> ''", "lost": f"NOT ({s} <> '' AND {s} = {t}) AND {t} <> '' AND {s} <> ''"}[part]
    return f"CASE WHEN {cond} THEN ['{name}:' || {t if part != 'lost' else s}] ELSE CAST([] AS VARCHAR[]) END"


_BUCKETS_SQL = ", ".join(
    f"array_to_string(list_sort(list_distinct(list_concat({base}, list_concat({_facet_sql('vocals', part)}, {_facet_sql('speed', part)})))), '|') AS {part}"
    for part, base in (("persistent", _BOTH.format(a="source_tags", b="target_tags")), ("added", _EXCEPT.format(a="target_tags", b="source_tags")), ("lost", _EXCEPT.format(a="source_tags", b="target_tags")))
)


@query(f"""WITH {_EDGES_SQL}, e AS (SELECT source, target, source_tags, target_tags, s.vocals AS s_vocals, t.vocals AS t_vocals, s.speed AS s_speed, t.speed AS t_speed
FROM edges JOIN clips s ON s.clip_id = source JOIN clips t ON t.clip_id = target)
SELECT source, target, {_BUCKETS_SQL} FROM e""")
def constraint_buckets(spark, sf):
    c = B.clips(spark, sf)
    s = c.select(F.col("clip_id").alias("source"), F.col("vocals").alias("sv"), F.col("speed").alias("ss"))
    t = c.select(F.col("clip_id").alias("target"), F.col("vocals").alias("tv"), F.col("speed").alias("ts"))
    e = edges(spark, sf).join(s, "source").join(t, "target")
    b = e.select("source", "target", D.buckets(F.col("source_tags"), F.col("target_tags"), F.col("sv"), F.col("tv"), F.col("ss"), F.col("ts")).alias("b"))
    return b.select("source", "target", *(_J(f"b.{k}").alias(k) for k in ("persistent", "added", "lost")))


_TT, _TP = B.turn_tags_sql("text"), B.turn_tags_sql("coalesce(previous, '')")


@query(f"""WITH {B.TURNS_SQL}, s AS (SELECT chain_id, turn, {_TT} AS t, {_TP} AS p FROM turns WHERE previous IS NOT NULL)
SELECT chain_id, turn, array_to_string({_EXCEPT.format(a='t', b='p')}, '|') AS added, array_to_string({_EXCEPT.format(a='p', b='t')}, '|') AS removed,
array_to_string({_BOTH.format(a='t', b='p')}, '|') AS preserved, CAST(len({_EXCEPT.format(a='t', b='p')}) + len({_EXCEPT.format(a='p', b='t')}) AS INTEGER) AS delta_size FROM s""")
def turn_deltas(spark, sf):
    s = B.turns(spark, sf).where("previous is not null").select("chain_id", "turn", B.turn_tags(F.col("text")).alias("t"), B.turn_tags(F.col("previous")).alias("p"))
    p, t = F.col("p"), F.col("t")
    return s.select("chain_id", "turn", _J(A.added(p, t)).alias("added"), _J(A.removed(p, t)).alias("removed"), _J(A.preserved(p, t)).alias("preserved"), A.delta_size(p, t).alias("delta_size"))


def _cont(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t))"


def _dd(expr: str, n: int) -> str:
    return f"array_to_string(list_filter(({expr}), lambda x, i: list_position(({expr}), x) = i)[1:{n}], '|')"


_FUZZY_SQL = f"""WITH {B.TURNS_SQL}, s AS (SELECT chain_id, turn, {_cont('previous')} AS st, {_cont('text')} AS tt, {_PHRASES_SQL.format(c='previous')} AS sp0, {_PHRASES_SQL.format(c='text')} AS tp0 FROM turns WHERE previous IS NOT NULL),
q AS (SELECT chain_id, turn, st, tt, {_DEDUP.format(l='sp0')} AS sp, {_DEDUP.format(l='tp0')} AS tp FROM s)
SELECT chain_id, turn, {_dd(_EXCEPT.format(a='tt', b='st'), 8)} AS added_terms, {_dd(_EXCEPT.format(a='st', b='tt'), 8)} AS removed_terms, {_dd(_BOTH.format(a='tt', b='st'), 8)} AS shared_terms,
{_dd(_EXCEPT.format(a='tp', b='sp'), 6)} AS added_phrases, {_dd(_EXCEPT.format(a='sp', b='tp'), 6)} AS removed_phrases, {_dd(_BOTH.format(a='tp', b='sp'), 6)} AS shared_phrases FROM q"""


@query(_FUZZY_SQL)
def fuzzy_text_diff(spark, sf):
    d = B.turns(spark, sf).where("previous is not null").select("chain_id", "turn", D.fuzzy_difference(F.col("previous"), F.col("text")).alias("d"))
    return d.select("chain_id", "turn", *(_J(f"d.{a}_{b}").alias(f"{a}_{b}") for b in ("terms", "phrases") for a in ("added", "removed", "shared")))


_TERMS_SQL = f"list_distinct({_cont('text')})"


@query(f"""WITH {B.TURNS_SQL}, s AS (SELECT chain_id, turn, {_TT} AS tags, list_sort({_TERMS_SQL}) AS terms, coalesce(lag({_TT}) OVER (PARTITION BY chain_id ORDER BY turn), CAST([] AS VARCHAR[])) AS prev FROM turns),
p AS (SELECT a.chain_id, a.turn, b.turn AS prior_turn, {_BOTH.format(a='a.tags', b='b.tags')} AS shared, {_BOTH.format(a='a.terms', b='b.terms')} AS st, a.prev FROM s a JOIN s b ON a.chain_id = b.chain_id AND b.turn < a.turn - 1),
q AS (SELECT *, {_EXCEPT.format(a='shared', b='prev')} AS re FROM p),
r AS (SELECT *, 3 * len(re) + 2 * len(shared) + len(st) AS score FROM q)
SELECT chain_id, turn, prior_turn, array_to_string(shared[1:6], '|') AS shared_tags, array_to_string(re[1:6], '|') AS reintroduced_tags, array_to_string(st[1:8], '|') AS shared_terms, CAST(score AS INTEGER) AS score, place
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY chain_id, turn ORDER BY score DESC, prior_turn) AS INTEGER) AS place FROM r WHERE score > 0) WHERE place <= 2""")
def history_refs(spark, sf):
    s = B.turns(spark, sf).select("chain_id", "turn", B.turn_tags(F.col("text")).alias("tags"), F.array_distinct(X.content_tokens(F.col("text"))).alias("terms"))
    h = D.history_references(s)
    return h.select("chain_id", "turn", "prior_turn", _J(F.slice("shared_tags", 1, 6)).alias("shared_tags"), _J(F.slice("reintroduced_tags", 1, 6)).alias("reintroduced_tags"), _J(F.slice("shared_terms", 1, 8)).alias("shared_terms"), "score", "place")


def _items(spark, sf):
    """The typed terms of each turn."""
    t = B.turns(spark, sf).where("previous is not null")
    terms = F.concat(F.array(F.lit("vocals:vocal"), F.lit("warm-pad"), F.lit("speed:slow")), F.array_distinct(X.content_tokens(F.col("text"))))
    return t.select("chain_id", "turn", D.semantic_items(terms, B.turn_tags(F.col("text")), F.array("previous"), F.array("seed")).alias("items"))


_ITEM_HINTS = " ".join(f"WHEN list_has_any(w, [{', '.join(repr(x) for x in words.split())}]) THEN '{k}'" for k, words in D.HINTS)
_ITEMS_SQL = f"""{B.TURNS_SQL}, tt AS (SELECT *, {_cont('text')} AS ct FROM turns WHERE previous IS NOT NULL),
i AS (SELECT chain_id, turn, unnest(list_concat(['vocals:vocal', 'warm-pad', 'speed:slow'], list_filter(ct, lambda x, i: list_position(ct, x) = i))) AS term, {_TT} AS tags, previous, seed FROM tt),
j AS (SELECT *, len(list_filter(tags, lambda x: contains(x, term))) > 0 AS in_tags, string_split(replace(term, '-', ' '), ' ') AS w FROM i),
k AS (SELECT *, CASE WHEN in_tags THEN 'tag' WHEN previous <> '' AND contains(lower(previous), term) THEN 'caption' WHEN seed <> '' AND contains(lower(seed), term) THEN 'lyrics' WHEN contains(term, ' ') THEN 'caption' ELSE 'semantic' END AS src FROM j),
items AS (SELECT chain_id, turn, term AS text, CASE WHEN starts_with(term, 'vocals:') OR starts_with(term, 'speed:') THEN 'tag' ELSE src END AS source,
CASE WHEN starts_with(term, 'vocals:') THEN 'vocal_status' WHEN starts_with(term, 'speed:') THEN 'speed' {_ITEM_HINTS} WHEN src = 'tag' THEN 'tag' ELSE 'semantic' END AS kind FROM k)"""


@query(f"WITH {_ITEMS_SQL} SELECT chain_id, turn, text, source, kind FROM items")
def typed_semantic_items(spark, sf):
    i = _items(spark, sf).select("chain_id", "turn", F.explode("items").alias("i"))
    return i.select("chain_id", "turn", "i.text", "i.source", "i.kind")


@query(f"""WITH {_ITEMS_SQL}, o AS (SELECT chain_id, turn, source, text FROM items)
SELECT chain_id, turn, coalesce(string_agg(DISTINCT text, '|' ORDER BY text) FILTER (source = 'tag'), '') AS tag_texts, coalesce(string_agg(DISTINCT text, '|' ORDER BY text) FILTER (source = 'caption'), '') AS caption_texts FROM o GROUP BY ALL""")
def typed_item_texts(spark, sf):
    g = _items(spark, sf).groupBy("chain_id", "turn").agg(F.flatten(F.collect_list("items")).alias("items"))
    return g.select("chain_id", "turn", *(_J(F.sort_array(D.typed_texts(F.col("items"), s))).alias(f"{s}_texts") for s in ("tag", "caption")))


_AXIS_SQL = "CASE WHEN source = 'lyrics' THEN 'lyrics_theme' " + " ".join(f"WHEN kind = '{k}' THEN '{a}'" for k, a in D.AXIS_OF_KIND.items()) + " ELSE 'other' END"


@query(f"""WITH {_ITEMS_SQL}, x AS (SELECT chain_id, turn, text, {_AXIS_SQL} AS axis, source = 'tag' AS is_new, source = 'caption' AS is_lost FROM items)
SELECT chain_id, turn, CASE WHEN count(*) FILTER (is_new OR is_lost) >= 2 THEN 'two_changes' WHEN count(*) FILTER (is_new OR is_lost) > 0 AND count(*) FILTER (NOT is_new AND NOT is_lost) > 0 THEN 'one_change_one_preservation' ELSE 'one_change' END AS shape,
CAST(count(*) FILTER (is_new OR is_lost) AS INTEGER) AS changes, CAST(count(*) FILTER (NOT is_new AND NOT is_lost) AS INTEGER) AS preservations,
coalesce(array_to_string(list_sort(list(DISTINCT axis) FILTER (is_new OR is_lost)), '|'), '') AS change_axes FROM x GROUP BY chain_id, turn""")
def instruction_plan(spark, sf):
    g = _items(spark, sf).groupBy("chain_id", "turn").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("all"))
    of = lambda s: F.filter("all", lambda x: x["source"] == s)
    kept = F.filter("all", lambda x: ~x["source"].isin("tag", "caption"))
    p = g.select("chain_id", "turn", D.plan(of("tag"), of("caption"), kept).alias("p"))
    return p.select("chain_id", "turn", "p.shape", F.size("p.changes").alias("changes"), F.size("p.preservations").alias("preservations"), _J(F.sort_array("p.change_axes")).alias("change_axes"))


@query(f"""WITH {B.TURNS_SQL} SELECT chain_id, turn, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS terms FROM (
SELECT chain_id, turn, list_concat(f, list_filter({_cont('text')}, lambda t: length(t) >= 4)) AS e FROM (SELECT *, {_cont('previous')} AS f FROM turns WHERE previous IS NOT NULL))""")
def evidence_terms(spark, sf):
    t = B.turns(spark, sf).where("previous is not null")
    return t.select("chain_id", "turn", _J(D.evidence_terms(X.content_tokens(F.col("previous")), F.col("text"))).alias("terms"))


@query(f"""WITH {B.TURNS_SQL}, s AS (SELECT chain_id, turn, text, lower(text) AS low, {_cont("coalesce(previous, '')")} AS ct, turn % 2 = 0 AS meta, turn % 3 = 1 AS capt FROM turns)
SELECT chain_id, turn, array_to_string(list_filter([CASE WHEN length(trim(text)) < 12 OR NOT regexp_matches(low, 'again|bring back|but|instead|keep|less|like|more|same|still|without') THEN 'format' END,
CASE WHEN len(ct) > 0 AND len(list_filter(ct, lambda x: contains(low, x))) = 0 THEN 'no_genuine_change' END,
CASE WHEN capt AND len(ct) > 0 AND len(list_filter(ct, lambda x: contains(low, x))) = 0 THEN 'caption_only_ungrounded' END,
CASE WHEN NOT meta AND regexp_matches(low, '\\b(artist|band|singer|album|\\d{{4}})\\b') THEN 'metadata_invention' END,
CASE WHEN contains(low, 'as before') THEN 'requires_history' END], lambda x: x IS NOT NULL), '|') AS reasons FROM s""")
def instruction_precheck(spark, sf):
    t = B.turns(spark, sf)
    terms = X.content_tokens(F.coalesce("previous", F.lit("")))
    r = D.precheck(F.col("text"), terms, F.pmod("turn", F.lit(2)) == 0, False, F.pmod("turn", F.lit(3)) == 1, terms, terms)
    return t.select("chain_id", "turn", _J(r).alias("reasons"))


@query(f"""WITH {B.TURNS_SQL} SELECT chain_id, turn, CAST(count(*) OVER w AS INTEGER) AS n_priors, coalesce(string_agg(CAST(turn AS VARCHAR), ' ') OVER w, '') AS prior_turns, role AS current_role
FROM turns WINDOW w AS (PARTITION BY chain_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_turn_join(spark, sf):
    p = N.prior_turns(B.turns(spark, sf), "chain_id", "turn", F.col("role"))
    return p.select("chain_id", "turn", F.size("priors").alias("n_priors"), F.array_join(F.transform("priors", lambda x: x["turn"].cast("string")), " ").alias("prior_turns"), F.col("role").alias("current_role"))


@query(f"""WITH {B.TURNS_SQL} SELECT chain_id, turn, CASE WHEN trim(coalesce(previous, '')) <> '' OR turn % 2 = 0 THEN coalesce(trim(previous), '') ELSE 'old' END AS source_len_base,
CAST(length(text) AS INTEGER) AS target_len, CAST(length(coalesce(seed, '')) AS INTEGER) AS seed_len, {_dd(_BOTH.format(a=_cont('text'), b=_cont('seed')), 8)} AS seed_shared FROM turns""")
def step_payload_flat(spark, sf):
    t = B.turns(spark, sf)
    source = F.when((F.trim(F.coalesce("previous", F.lit(""))) != "") | (F.pmod("turn", F.lit(2)) == 0), F.coalesce(F.trim("previous"), F.lit(""))).otherwise("old")
    d = D.fuzzy_difference(F.col("seed"), F.col("text"))
    return t.select("chain_id", "turn", source.alias("source_len_base"), F.length("text").alias("target_len"), F.length(F.coalesce("seed", F.lit(""))).alias("seed_len"), _J(d["shared_terms"]).alias("seed_shared"))
