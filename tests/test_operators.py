"""Operators over small fixtures: ties, nulls, empty tables, repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.operators import deltas as D
from stepwright.operators import gate as G
from stepwright.operators import graph as W
from stepwright.operators import ingest as I
from stepwright.operators import joins as N
from stepwright.operators import keys as K
from stepwright.operators import metrics as M
from stepwright.operators import pools as P
from stepwright.operators import reports as R
from stepwright.operators import search as S
from stepwright.operators import vectors as V


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n"), ("a", 2, "y")], "k string, t int, v string")
    want = [("a", "y"), ("b", "z"), (None, "n")]
    assert rows(K.latest_by(df, ["k"], ["t"]), "k", "v") == sorted(want, key=repr)
    assert rows(K.latest_values(df, ["k"], ["t"], ["v"]), "k", "v") == sorted(want, key=repr)
    assert ("a", "x") in rows(K.first_by(df, ["k"], ["t"]), "k", "v")
    assert K.latest_by(df.limit(0), ["k"], ["t"]).collect() == []


def test_dense_index_has_no_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(9)
    got = rows(K.dense_index(df, ["x"]), "x", "row_idx")
    assert sorted(got) == [(k, k) for k in range(5000)]


def test_ordinal_before_distinct(spark):
    df = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "a"), ("t", 4, "c")], "k string, s int, v string")
    assert rows(K.distinct_with_ordinal(df, ["k"], ["s"], "v"), "v", "ordinal") == [("a", 1), ("b", 2), ("c", 4)]


def test_quota_then_fill(spark):
    df = spark.createDataFrame([(1, "A", k) for k in range(5)] + [(1, "B", k) for k in range(10, 12)] + [(1, "C", 99)], "g int, t string, s int")
    out = K.quota_pick(df, ["g"], "t", {"A": 2, "B": 1}, [F.col("s").desc()], [F.col("s").desc()], 5)
    assert rows(out, "position", "t", "s") == [(1, "B", 11), (2, "A", 4), (3, "A", 3), (4, "C", 99), (5, "B", 10)]


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, 9.0)], "g int, v double")
    assert rows(K.average_rank(df, ["g"], "v", "r"), "v", "r") == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (9.0, 4.0)]


def test_average_ranks_by_counts(spark):
    """Nulls come last, in keys too, as in the SQL; only counts are shuffled."""
    from measure import moved

    df = spark.createDataFrame([("a", 5), ("a", None), ("a", 1), ("a", None), (None, 2), (None, 2)], "g string, v int")
    assert rows(K.average_rank(df, ["g"], "v", "r"), "g", "v", "r") == sorted([("a", 1, 1.0), ("a", 5, 2.0), ("a", None, 3.5), ("a", None, 3.5), (None, 2, 1.5), (None, 2, 1.5)], key=repr)
    pairs = spark.range(8000).select(F.lit("q").alias("q"), (F.col("id") % 5).alias("x"), (F.col("id") % 3).alias("y"))
    assert moved(spark, lambda: M.agreement(pairs, ["q"]).collect())[0] < 1000


def test_balanced_order_of_the_first(spark):
    from measure import moved

    df = spark.range(6000).select("id", F.when(F.col("id") < 5, "few").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("s"), F.sha1(F.col("id").cast("string")).alias("h"))
    whole = K.balanced_order(df, "s", "h")
    assert whole.count() == 6000
    got = []
    assert moved(spark, lambda: got.extend(rows(K.balanced_order(df, "s", "h", most=40), "id", "position")))[0] < 2000
    assert got == rows(whole.where("position <= 40"), "id", "position")


def test_long_chains_of_tags_in_one_pass(spark):
    """600 turns of 12 tags each: each turn's state as by a walk over the moves; before, each looked at all pairs of moves."""
    import time

    rng = np.random.default_rng(3)
    data, at, want = [], {}, {}
    for turn in range(600):
        tags = [f"t{k:03}" for k in rng.choice(400, 12, replace=False)]
        data.append((1, turn, tags[:6], tags[6:]))
        at |= {x: 1 for x in tags[:6]} | {x: 0 for x in tags[6:]}
        want[turn] = tuple(sorted(x for x, op in at.items() if op == side) for side in (1, 0))
    s = spark.createDataFrame(data, "chain_id long, turn int, tags_added array<string>, tags_removed array<string>")
    began = time.time()
    got = {r["turn"]: (r["added_cumulative"], r["removed_cumulative"]) for r in W.cumulative_state(s).collect()}
    assert got == want
    assert time.time() - began < 30


def test_items_search_each_text_once(spark):
    """The evidence is joined before the terms: typing a turn's terms does not copy or scan its tags one by one."""
    df = spark.createDataFrame([(["night-drive", "piano", "vocals:x", "two words", "gone", " "], ["Pianos", "", "lo"], ["A night-drive home"], [None])], "t array<string>, tags array<string>, captions array<string>, lyrics array<string>")
    got = df.select(D.semantic_items(*(F.col(c) for c in df.columns)).alias("i")).first()["i"]
    assert [tuple(x) for x in got] == [("night-drive", "caption", "semantic"), ("piano", "tag", "instrument"), ("vocals:x", "tag", "vocal_status"), ("two words", "caption", "semantic"), ("gone", "semantic", "semantic"), ("", "tag", "tag")]
    apart = df.select(F.explode("t").alias("term"), "tags", "captions", "lyrics").select(D.semantic_item(F.col("term"), F.col("tags"), F.col("captions"), F.col("lyrics")).alias("i")).collect()
    assert [tuple(r["i"]) for r in apart] == [tuple(x) for x in got]


def test_genres_by_plain_search(spark):
    from stepwright.functions import labels as L

    df = spark.createDataFrame([(["R&B", "x"],), (["rxb"],), ([None, "Hip-Hop"],), (["popular"],), ([],)], "t array<string>")
    expr = df.select(L.genre(F.col("t")).alias("g"))
    assert [r["g"] for r in expr.collect()] == ["Soul/R&B", "Other", "Hip-hop", "Pop", "Other"]
    assert "RLIKE" not in expr._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_and_gate(spark):
    v = spark.createDataFrame([(1, 1, 0, 5.0), (1, 1, 1, 3.0), (1, 2, 0, 2.0), (1, 2, 1, 3.0), (1, 3, 0, 5.0), (2, 1, 0, None), (3, 1, 0, 4.0), (3, 1, 1, 4.0)], "chain_id int, turn int, variant int, score double")
    g = G.grade(v, "score")
    assert rows(g, "chain_id", "turn", "best_variant", "step_accepted", "truncate_at", "prefix_end", "chain_score") == sorted([(1, 1, 0, True, 2, 1, 3.0), (1, 2, 1, False, 2, 1, 3.0), (1, 3, 0, True, 2, 1, 3.0), (2, 1, 0, False, 1, None, None), (3, 1, 0, True, None, 1, 4.0)], key=repr)
    assert rows(G.select(g), "chain_id", "turn", "contextual_accepted") == [(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, False), (3, 1, True)]
    assert rows(G.select(g, "truncate"), "chain_id", "turn") == [(1, 1), (3, 1)] and rows(G.select(g, "drop"), "chain_id") == [(3,)]
    assert G.grade(v.limit(0), "score").collect() == []


def test_group_split_fills_in_order(spark):
    df = spark.createDataFrame([(k, f"a{k % 20}" if k % 10 else " ") for k in range(200)], "id int, artist string")
    out = I.group_split(df, "artist")
    assert out.count() == 200 and out.groupBy("artist").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert n["train"] >= 180 and sum(n.values()) == 200
    assert rows(out, "id", "split") == rows(I.group_split(df.repartition(5), "artist"), "id", "split")


def test_vocabulary(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "c"],), (["b"],), (None,), ([],)], "tags array<string>")
    assert rows(I.vocabulary(df, "tags", 2), "tag", "n") == [("a", 2), ("b", 2)]
    assert I.vocabulary(df, "tags", 0).collect() == [] and I.vocabulary(df, "tags", None).count() == 3
    kept = I.keep_vocabulary(df, "tags", I.vocabulary(df, "tags", 1))
    assert sorted(map(repr, [r[0] for r in kept.collect()])) == sorted(["['a']", "['a']", "[]", "[]", "None"])


def test_joins(spark):
    m = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "k string, caption string")
    r = spark.createDataFrame([("a", "new"), ("b", " ")], "k string, v string")
    assert rows(N.with_rewrites(m, r, "k", "v", "caption", overwrite=True), "k", "caption", "has_rewrite") == [("a", "new", True), ("b", "old", False), ("c", "old", False)]
    assert rows(N.with_rewrites(m, r, "k", "v", "caption", keep_unmatched=False), "k") == [("a",)]
    assert rows(N.pending(m, r, "k"), "k") == [("c",)]
    assert rows(N.union_of_keys([m, r], "k"), "k", "v") == [("a", "new"), ("b", " "), ("c", None)]


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    data = [(k, k // 2, "abc"[k % 3] if k < 88 else None, sorted({f"t{k % 4}", f"t{k % 7}"}), [float(x) for x in v[k]], [float(x) for x in v[(k * 7) % 90]]) for k in range(90)]
    return spark.createDataFrame(data + [(500, 500, "lonely", [], [1.0] + [0.0] * 7, [1.0] + [0.0] * 7)], "clip_id long, track_id long, split string, tags array<string>, audio array<double>, text_vec array<double>")


@pytest.mark.parametrize("least", [None, 0.2])
def test_blocked_neighbours_equal_the_join(clips, least):
    a = V.knn_join(clips, 5, least=least)
    for block in (7, 4096):
        assert rows(V.knn_blocks(clips, 5, block_rows=block, least=least), "source", "target", "rank") == rows(a, "source", "target", "rank")
    assert V.knn_blocks(clips.limit(0), 5).collect() == []


def test_blocked_neighbours_send_each_clip_a_few_times(spark):
    """Small blocks: a clip goes to 16 blocks at most, and only the k best come back; ties by id, repeated vectors."""
    from measure import moved

    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(100, 8)), 4, axis=0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    clips = spark.createDataFrame([(k, k // 2, "a", [float(x) for x in v[k]]) for k in range(400)], "clip_id long, track_id long, split string, audio array<double>")
    got = V.knn_blocks(clips, 5, block_rows=2)
    assert moved(spark, lambda: got.write.format("noop").mode("overwrite").save())[0] <= 400 * 16 + 400 * 5
    assert rows(got, "source", "target", "rank") == rows(V.knn_join(clips, 5), "source", "target", "rank")


def test_knn_topk_makes_no_table_of_pairs(spark):
    from measure import moved
    from oracle import SF

    from stepwright import catalog

    df = catalog.queries()["knn_topk"](spark, SF)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()  # blocks; a join of all pairs before
    assert moved(spark, lambda: df.write.format("noop").mode("overwrite").save())[0] < 500 * 40


def test_neighbours_equal_brute_force(clips):
    data = [r for r in clips.collect() if r["split"] is not None]
    for s in data[:12]:
        near = sorted((-round(float(np.dot(s["audio"], t["audio"])), 9), t["clip_id"]) for t in data if t["split"] == s["split"] and t["track_id"] != s["track_id"])[:4]
        got = V.knn_join(clips, 4).where(F.col("source") == s["clip_id"]).orderBy("rank").collect()
        assert [r["target"] for r in got] == [i for _, i in near]


def test_adjacency_offsets(spark):
    edges = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (3, 1, 1)], "source long, target long, rerank_rank int")
    nodes = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 70_000)], "node long")
    assert rows(W.csr_offsets(edges, nodes), "node", "degree", "offset") == [(0, 0, 0), (1, 2, 0), (2, 0, 2), (3, 1, 2), (70_000, 0, 3)]
    empty = W.csr_offsets(edges.limit(0), nodes)
    assert {r["offset"] for r in empty.collect()} == {0}


def test_walks_never_come_back(spark, clips):
    edges = V.rerank(V.knn_blocks(clips, 20), clips, most_changed=None, retain=10)
    edges = W.transitions(edges, 20)
    steps = W.walks(edges, clips, 60)
    tracks = {r["clip_id"]: r["track_id"] for r in clips.collect()}
    known = {(r["source"], r["target"]) for r in edges.collect()}
    chains: dict = {}
    for r in steps.orderBy("chain_id", "turn").collect():
        c = chains.setdefault(r["chain_id"], [r["source"]])
        assert c[-1] == r["source"] and (r["source"], r["target"]) in known
        c.append(r["target"])
        assert len({tracks[x] for x in c}) == len(c) == r["turn"] + 1 <= 7
    assert len(chains) == 60
    assert rows(W.walks(edges.repartition(3), clips, 60), *steps.columns) == rows(steps, *steps.columns)
    assert W.walks(edges.limit(0), clips, 5).collect() == []


def test_cumulative_state(spark):
    s = spark.createDataFrame([(1, 1, ["a"], ["b"]), (1, 2, ["b"], ["a"]), (1, 3, [], []), (2, 1, [], ["z"])], "chain_id int, turn int, tags_added array<string>, tags_removed array<string>")
    got = W.cumulative_state(s).orderBy("chain_id", "turn").collect()
    assert [(r["added_cumulative"], r["removed_cumulative"]) for r in got] == [(["a"], ["b"]), (["b"], ["a"]), (["b"], ["a"]), ([], ["z"])]


def test_buckets(spark):
    df = spark.createDataFrame([(["x", "y"], ["y", "z"], "vocal", "instrumental", "slow", "slow"), ([], [], "vocal", "", "", "fast")], "s array<string>, t array<string>, sv string, tv string, sp string, tp string")
    got = [r[0].asDict() for r in df.select(D.buckets(*(F.col(c) for c in df.columns))).collect()]
    assert got == [{"persistent": ["speed:slow", "y"], "added": ["vocals:instrumental", "z"], "lost": ["vocals:vocal", "x"]}, {"persistent": [], "added": ["speed:fast"], "lost": []}]


def test_pool_types(spark):
    df = spark.createDataFrame([(True, ["a"], [], 0.0), (False, [], ["k"], 0.9), (False, [], [], 0.6), (False, [], [], 0.4), (False, [], [], 0.1), (False, ["a"], [], 0.9), (False, [], [], 0.3), (False, ["a", "b"], [], 0.9)], "target boolean, fc array<string>, fk array<string>, al double")
    got = [tuple(r[0]) for r in df.select(P.pool_type(F.col("target"), F.col("fc"), F.col("fk"), F.col("al"))).collect()]
    partial, soft = ("Type_PARTIAL", 1, "partial_constraint_miss"), ("Type_PARTIAL", 2, "soft_semantic_partial")
    assert got == [("Type_TARGET", 4, "target"), ("Type_H", 1, "history_shortcut"), ("Type_STRONG", 4, "strong_positive"), ("Type_STRONG", 3, "strong_positive"), ("Type_T", 2, "caption_miss"), partial, soft, ("Type_HARD_NEG", 0, "hard_negative")]


STEP = "step int, source int, target int, seed int, prior array<int>, references array<int>, terms struct<new: array<string>, lost: array<string>, kept: array<string>>"


def test_candidates_by_hand(spark):
    """Ranks of clips that are no neighbours, the four neighbourhoods, and the end at 4 * most neighbours or clips."""
    steps = spark.createDataFrame([(1, 10, 20, 30, [11, 10], [11], ([], [], []))], STEP)
    e = [(10, 20, 1, 2, 0.9, 0.1, 0.5), (10, 40, 2, 1, 0.8, 0.9, 0.6), (20, 40, 5, 1, 0.95, 0.2, 0.3), (30, 50, 1, 1, 0.7, 0.0, 0.2), (11, 60, 1, 1, 0.6, 0.0, 0.1)]
    edges = spark.createDataFrame(e, "source int, target int, audio_rank int, rerank_rank int, audio_similarity double, text_similarity double, rerank_score double")
    got = {r["clip"]: r for r in P.merge_candidates(P.candidate_sources(steps, edges), 8).collect()}
    assert {k: list(r["labels"]) for k, r in got.items()} == {20: ["exact_target", "source_neighborhood"], 10: ["source_clip", "chain_history_target"], 11: ["chain_history_target"], 40: ["source_neighborhood", "target_neighborhood"], 50: ["seed_neighborhood"], 60: ["history_reference_neighborhood"]}
    assert (got[20]["rerank_rank"], got[20]["audio_similarity"], got[20]["to_source"], got[20]["to_target"], got[20]["is_target"]) == (2, 1.0, 0.9, 1.0, True)
    assert (got[11]["audio_rank"], got[11]["rerank_score"]) == (P.NO_RANK, 0.0)
    assert (got[40]["audio_rank"], got[40]["to_target"], got[40]["to_source"], got[40]["text_similarity"]) == (2, 0.95, 0.8, 0.9)
    assert set(r["clip"] for r in P.merge_candidates(P.candidate_sources(steps, edges, 0.25), 8).collect()) == {20, 10, 11, 40}
    many = spark.createDataFrame([(10, 100 + k, k, k, 0.5, 0.5, 0.5) for k in range(1, 30)], edges.schema)
    # Target, source and one earlier clip, then neighbours up to 4 different clips in all: one.
    assert sorted(r["clip"] for r in P.merge_candidates(P.candidate_sources(steps, many), 1).collect()) == [10, 11, 20, 101]


def test_scores_by_hand(spark):
    steps = spark.createDataFrame([(1, 10, 20, 30, [], [], (["vocals:vocal", "jazz", "warm strings"], ["rock"], ["calm"]))], STEP)
    clip = "clip_id int, tags array<string>, caption string, lyrics string, vocals string, speed string, split string, text_vec array<double>"
    clips = spark.createDataFrame([(10, ["rock", "calm"], "slow rock", "", "instrumental", "slow", "val", [1.0, 0.0]), (20, ["jazz", "calm"], "warm strings here", "", "vocal", "slow", "val", [0.0, 1.0]), (40, ["jazz"], "Warm strings and rock", "", "vocal", "fast", "val", [0.6, 0.8])], clip)
    names = ["audio_rank", "rerank_rank", "ordinal", "audio_similarity", "text_similarity", "rerank_score", "to_target", "to_seed", "to_source"]
    cand = spark.createDataFrame([(1, 40, 1, 1, 7, 0.5, 0.3, 0.4, 0.0, 0.2, 0.1, False, ["x"]), (1, 20, 1, 1, 0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, True, ["t"])], "step int, clip int, " + ", ".join(f"{n} {'int' if n.endswith('rank') or n == 'ordinal' else 'double'}" for n in names) + ", is_target boolean, labels array<string>")
    got = {r["clip"]: r for r in P.scored(cand, steps, P.prepared(clips)).collect()}
    r = got[40]
    # Tags alone: vocals and jazz of three new ones, rock is away, calm is not there; captions: warm strings is the one caption term.
    assert (round(r["constraints"]["add"], 6), r["constraints"]["remove"], r["constraints"]["preserve"]) == (0.666667, 1.0, 0.0)
    assert [[t["text"] for t in x] for x in r["in_captions"]] == [["warm strings"], [], []] and r["caption_constraints"]["mean"] == 1.0
    # The caption says rock, so the lost term is there; calm is kept nowhere.
    assert (r["failed_change"], r["failed_keep"]) == (["rock"], ["calm"]) and r["satisfied"] == ["vocals:vocal", "jazz", "warm strings"]
    assert (r["text_recall"], r["text_precision"]) == (2 / 3, 2 / 4) and (r["tag_recall"], r["tag_precision"]) == (0.5, 1.0) and r["embedding_to_target"] == 0.8
    affinity, mean = max(0.1, 0.2, 1 / 2, 1 / 4), (2 / 3 + 1 + 0) / 3
    want = (0.15 * affinity + 0.25 * 0.0 + 0.2 * mean + 0.15 * 0.5 + 0.05 * 1.0 + 0.1 * 2 / 3 + 0.05 * 0.5 + 0.1 * max(0.4, 0.3)) / 1.05
    assert r["final"] == round(want, 9) and r["alignment"] == 1.0 and (r["pool_type"], r["grade"]) == ("Type_HARD_NEG", 0)
    assert (got[20]["pool_type"], got[20]["failed"]) == ("Type_TARGET", [])


def test_pool_order_and_judge(spark):
    kinds = ["Type_TARGET"] + ["Type_HARD_NEG"] * 4 + ["Type_H", "Type_STRONG", "Type_T"]
    df = spark.createDataFrame([(1, k, k, t, P.TYPES[t][0], 0.9 - k / 100, 0.0, 0.0, "val", t == "Type_TARGET", P.TYPES[t][1]) for k, t in enumerate(kinds)], "step int, clip int, ordinal int, pool_type string, grade int, final double, to_target double, to_source double, split string, is_target boolean, failure_category string")
    # Type after type, not grade after grade; hard negatives beyond their quota of 2 fill up.
    assert rows(P.select_pool(df, 8).orderBy("position"), "position", "clip") == list(enumerate([0, 6, 5, 7, 1, 2, 3, 4], 1))
    assert rows(P.select_pool(df, 5), "position", "clip") == list(enumerate([0, 6, 5, 7, 1], 1))
    v = spark.createDataFrame([(1, 0, "Type_T", 2, None), (1, 1, "Type_STRONG", 4, None), (1, 5, None, None, None), (1, 7, "Type_T", None, "own words")], "step int, clip int, pool_type string, grade int, failure_category string")
    got = {r["clip"]: (r["pool_type"], r["grade"], r["failure_category"], r["label_source"], r["changed"]) for r in P.judged(df, v, ("val",)).collect()}
    assert got[0] == ("Type_TARGET", 4, "target", "deterministic", False) and got[1] == ("Type_STRONG", 4, "strong_positive", "llm_judge", True)
    assert got[5] == ("Type_H", 1, "history_shortcut", "llm_judge", False) and got[7] == ("Type_T", 2, "own words", "llm_judge", False)
    assert {r["label_source"] for r in P.judged(df, v, ("test",)).collect()} == {"deterministic"}


def test_reason_codes_and_solvability(spark):
    df = spark.createDataFrame([(None, ""), ("Type_TARGET", "target"), ("Type_STRONG", "strong_positive"), ("Type_H", "history_shortcut"), ("Type_T", "caption_miss"), ("Type_PARTIAL", "soft_semantic_partial"), ("Type_PARTIAL", ""), ("Type_HARD_NEG", "own words")], "t string, f string")
    got = [r[0] for r in df.select(P.reason_code(F.col("t"), F.col("f"))).collect()]
    assert got == ["failed:too_semantically_far_from_target", "success:target", "success:strong", "failed:history_shortcut", "failed:caption_miss", "failed:partial_constraint_miss", "failed:unclassified", "failed:own words"]
    s = spark.createDataFrame([(1, 1, True, 0.2, 0.6), (1, 2, False, 0.7, 0.1), (2, 1, False, 0.9, 0.9), (3, 1, True, 0.1, 0.2), (4, 9, True, 0.5, 0.5), (4, 3, False, 0.5, 0.1)], "step int, clip int, is_target boolean, lexical_score double, encoder_score double")
    assert rows(P.solvability(s), "step", "target_rank", "target_score", "target_encoder_score", "flagged") == [(1, 2, 0.6, 0.6, True), (2, None, 0.0, 0.0, False), (3, 1, 0.2, 0.2, False), (4, 2, 0.5, 0.5, True)]


def test_agreement_at_its_edges(spark):
    df = spark.createDataFrame([("same", 4, 4)] * 5 + [("two", 1, 5), ("two", 5, 1)] + [("mixed", k, 6 - k) for k in range(1, 6)], "q string, x int, y int")
    got = {r["q"]: r for r in M.agreement(df, ["q"]).collect()}
    assert got["same"]["pearson_r"] is None and got["same"]["accept_kappa"] is None and got["same"]["accept_ac1"] == 1.0 and got["same"]["quadratic_kappa"] is None
    assert got["two"]["pearson_r"] is None and got["two"]["n_items"] == 2
    assert got["mixed"]["pearson_r"] == -1.0 == got["mixed"]["spearman_r"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.49, 0.5, 1.0, 1.01, None)], "v double")
    assert rows(R.histogram(df, F.col("v"), 2, 0.0, 1.0), "bin", "n") == [(0, 2), (1, 2)]
    with pytest.raises(ValueError):
        R.histogram(df, F.col("v"), 2, 1.0, 1.0)


def brute_search(tracks, text):
    """{track: (stage, score)} by a plain walk: tracks in order of their keys, with lists of parts."""
    import difflib
    import re

    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    each = {k: " ".join(dict.fromkeys(p.strip() for p in parts if p and p.strip())).lower() for k, parts in tracks.items()}
    words = {k: list(dict.fromkeys(re.findall("[a-z0-9]+", t))) for k, t in each.items()}
    vocabulary = sorted({w for v in words.values() for w in v})
    q = text.strip().lower()
    tokens = list(dict.fromkeys(re.findall("[a-z0-9]+", q)))
    similar = []
    for t in tokens:
        if len(t) >= 3 and len(similar) < 12:
            similar += [w for _, w in sorted(((ratio(t, w), w) for w in vocabulary if w[:2] == t[:2] and ratio(t, w) >= 0.82), reverse=True)[:3]]
    stages = [("all", set(each) if not tokens else set()), ("exact", {k for k in each if set(tokens) & set(words[k])}), ("fuzzy", {k for k in each if set(similar[:12]) & set(words[k])}), ("substring", {k for k in each if tokens and q in each[k][:1200]})]
    stage, found = next(((n, f) for n, f in stages if f), ("none", set()))
    out = {}
    for k in found:
        exact, partial = sum(t in words[k] for t in tokens), sum(t in each[k] for t in tokens)
        close = sum(any(ratio(t, w) >= 0.84 for w in words[k][:120]) for t in tokens)
        n = max(len(tokens), 1)
        score = 1.0 if not q else 4 + min(len(q) / 120, 1) if q in each[k] else 3 + exact / n if exact else 2 + partial / n if partial else 1 + close / n if close else 0.0
        out[k] = (stage, round(score, 9))
    return out


def test_search(spark):
    texts = {1: ["Warm piano", None, "warm  strings", "piano"], 2: ["Cold synth", "", "a long quiet night of synths and pads"], 3: [None, None], 4: ["pianist plays", "warm pian"], 5: ["piano concerto in the park, warm and slow, for a long night"]}
    asked = ["piano", "pianno", "old syn", "zzz", "", " -- ", "Warm  strings", "long quiet night", "concert in the park", "warn pianoo", "wrm pads", "piano concerto in the park, warm and", "ianis", "pianiste", "a long night piano zz", "qu", "stringss synthss padss warmm pianoo nightt"]
    t = spark.createDataFrame([(k, n, p) for k, parts in texts.items() for n, p in enumerate(parts)], "k int, pos int, part string")
    tracks = S.roll_up(t, "k", "pos", ["part"])
    index = S.inverted_index(tracks, "k")
    q = S.query_tokens(spark.createDataFrame(list(enumerate(asked)), "q int, text string"), "text")
    found = S.candidates(q, tracks, index, "q", "k")
    stages = {(r["q"], r["k"]): r["stage"] for r in found.collect()}
    got = {(r["q"], r["k"]): (stages[r["q"], r["k"]], round(r["score"], 9)) for r in S.scores(found, q, tracks, "q", "k").collect()}
    want = {(n, k): v for n, text in enumerate(asked) for k, v in brute_search(texts, text).items()}
    assert got == want
    assert {s for s, _ in got.values()} == {"all", "exact", "fuzzy", "substring"} and {int(x) for _, x in got.values()} == {0, 1, 2, 3, 4}


def test_fuzzy_matches_by_brute_force(spark):
    import difflib

    words = ["pian", "piano", "pianos", "pianist", "pineapple", "pi", "p", "warm", "warmer", "swarm"]
    tokens = ["piano", "pianno", "warmr", "pi", "wa", "xyz"]
    got = {}
    table = lambda v: spark.createDataFrame([(x,) for x in v], "token string")
    for r in S.fuzzy_matches(table(tokens), table(words)).collect():
        got.setdefault(r["token"], []).append((r["ratio"], r["word"]))
    want = {}
    for t in tokens:
        near = sorted(((difflib.SequenceMatcher(None, t, w).ratio(), w) for w in words if len(t) >= 3 and w[:2] == t[:2]), reverse=True)
        near = [x for x in near if x[0] >= 0.82][:3]
        if near:
            want[t] = near
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == want


def test_step_flattening_keeps_every_chain(spark, tmp_path):
    from stepwright.queries.chains import step_flattening

    spark.createDataFrame([(1,), (2999,), (3000,), (90000,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    item = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame([(k, 1, 3, 1, 7.0, 1.0, 0.0, 0.0, "N", "O", None) for k in (1, 3000)], item).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in step_flattening(spark, str(tmp_path)).collect())
    assert [(r[0], r[1]) for r in got] == [(1, 1), (2999, None), (3000, 1), (90000, None)]


def test_step_flattening_odd_rows_by_sql(spark, tmp_path):
    """Fractional, negative and missing quantities, and missing values in what numbers the variants; all orders are below the SQL's 3,000."""
    import duckdb
    import oracle

    from stepwright import catalog

    odd = [(k, 1, 3, q) for k, q in enumerate([7.5, 2.5, 1.5, 0.5, -0.5, -2.5, -3.0, -7.0, None, 7.0], 1)]
    odd += [(11, 1, None, 2.0), (11, 1, 1, 3.0), (11, 1, 2, 4.0), (11, 2, 1, None), (11, 2, 1, 8.0), (None, 1, 1, 1.0), (12, None, 1, 1.0)]
    item = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    tables = {
        "orders": spark.createDataFrame([(k,) for k in [*range(1, 14), 2999, 2999, -1]], "o_orderkey long"),
        "lineitem": spark.createDataFrame([(k, n, p, 1, q, 1.0, 0.0, 0.0, "N", "O", None) for k, n, p, q in odd], item),
    }
    con = duckdb.connect()
    for name, t in tables.items():
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = oracle.of_spark(catalog.queries()["step_flattening"](spark, str(tmp_path)))
    assert oracle.difference(got, oracle.of_sql(con, catalog.oracle_sql()["step_flattening"])) == ""


def test_all_candidates_count_without_a_cap(spark):
    """A step with 40 neighbours has all of them, and the SQL of relevance_pool and solvability cuts none; the others' SQL does."""
    from stepwright import catalog

    steps = spark.createDataFrame([(1, 10, 20, 1, [], [])], "step long, source long, target long, seed long, prior array<long>, references array<long>")
    edges = spark.createDataFrame([(10, 100 + k, k, k, 0.5, 0.5, 0.5) for k in range(1, 41)], "source long, target long, audio_rank int, rerank_rank int, audio_similarity double, text_similarity double, rerank_score double")
    assert P.merge_candidates(P.candidate_sources(steps, edges)).count() == 42
    cut = {n for n, sql in catalog.oracle_sql().items() if "clips_before <" in sql}
    assert not cut & {"relevance_pool", "solvability"} and "candidate_merge" in cut


def test_reasons_of_a_split_without_a_shuffle_of_pairs(spark):
    """50 steps by 400 clips: the pairs are made where the steps are; a step's candidates keep what they have, repeated ones too."""
    from measure import moved

    clips = spark.range(400).select(F.col("id").alias("clip"), F.lit("a").alias("split"))
    data = [(s, c, "a", c == s, "Type_TARGET" if c == s else "Type_H", "x", 4 if c == s else 1) for s in range(50) for c in (s, s + 100)] + [(0, 100, "a", False, "Type_T", "y", 2)]
    rows_ = spark.createDataFrame(data, "step long, clip long, split string, is_target boolean, pool_type string, failure_category string, grade int")
    columns = ("step", "clip", "reason_code", "failure_category", "grade", "label")
    got = []
    assert moved(spark, lambda: got.extend(rows(P.reason_codes_of_splits(clips, rows_, 64), *columns)))[0] < 5000
    every = rows_.where("is_target").select("step").crossJoin(clips.select("clip"))
    assert got == rows(P.reason_codes(every, rows_.drop("split", "is_target")), *columns) and len(got) == 50 * 400 + 1
