"""Transition edges, adjacency and random walks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions import arrays as A
from stepwright.functions.labels import clip01, hardness
from stepwright.functions.sampling import exponential_key, uniform
from stepwright.operators.keys import dense_index, sum_before
from stepwright.storage import written


def transition_score(audio: Column, text: Column, delta: Column, most_changed: int = 6, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    if sum(weights) <= 0:
        raise ValueError("the weights must sum to more than 0")
    tag = clip01(1 - delta / max(1, most_changed))
    return clip01((weights[0] * clip01(audio) + weights[1] * clip01(text) + weights[2] * tag) / sum(weights))


def transitions(edges: DataFrame, most_changed: int = 6, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """Edges of rerank() with score, cost, hardness and the tag difference; those with more changes are left."""
    s, t = F.col("source_tags"), F.col("target_tags")
    out = edges.where(F.col("tag_delta_size") <= most_changed)
    out = out.withColumn("transition_score", transition_score(F.col("audio_similarity"), F.col("text_similarity"), F.col("tag_delta_size"), most_changed, weights))
    out = out.withColumns({"transition_cost": 1 - F.col("transition_score"), "hardness": hardness(F.col("tag_delta_size")), "tags_preserved_count": F.size(A.preserved(s, t))})
    return out.withColumns({"tags_added": A.added(s, t), "tags_removed": A.removed(s, t), "tags_preserved": A.preserved(s, t)})


def edge_status(edges: DataFrame, nodes: DataFrame, clips: DataFrame, most_changed: int) -> DataFrame:
    """edges with status: missing_node, missing_clip, cross_split, tag_delta or ok, the first that holds.

    nodes: node, clip_id; clips: clip_id, split, tags; edges: source, target (nodes).
    """
    n = nodes.join(clips.withColumn("_clip", F.lit(True)), "clip_id", "left").select("node", F.coalesce("_clip", F.lit(False)).alias("has_clip"), "split", "tags")
    one = n.select(F.col("node").alias("source"), F.col("has_clip").alias("_cs"), F.col("split").alias("_ss"), F.col("tags").alias("_ts"))
    two = n.select(F.col("node").alias("target"), F.col("has_clip").alias("_ct"), F.col("split").alias("_st"), F.col("tags").alias("_tt"))
    e = edges.join(one, "source", "left").join(two, "target", "left")
    status = (
        F.when(F.col("_cs").isNull() | F.col("_ct").isNull(), "missing_node")
        .when(~F.col("_cs") | ~F.col("_ct"), "missing_clip")
        .when(F.col("_ss") != F.col("_st"), "cross_split")
        .when(A.delta_size(F.col("_ts"), F.col("_tt")) > most_changed, "tag_delta")
        .otherwise("ok")
    )
    return e.withColumn("status", status).select(*edges.columns, "status")


def adjacency(edges: DataFrame, score: str = "transition_score") -> DataFrame:
    """source, degree and neighbours (rank, target, score), each source in one row: what a reader seeks by source."""
    row = F.sort_array(F.collect_list(F.struct("rerank_rank", "target", F.col(score).alias("score"))))
    return edges.groupBy("source").agg(F.count("*").alias("degree"), row.alias("neighbours"))


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree and offset of its first edge when edges are laid out by node; nodes without edges have degree 0."""
    degree = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    full = nodes.select("node").join(degree, "node", "left").fillna(0, ["degree"])
    return sum_before(full, ["node"], "degree", "offset").select("node", "degree", "offset")


def walks(edges: DataFrame, clips: DataFrame, n: int, longest: int = 6, least: int = 1, seed: int = 13, mu: float = 0.7, sigma: float = 0.75) -> DataFrame:
    """chain_id, turn, source, target, transition_score: n random walks without revisits of a clip or a track.

    Lengths are lognormal, rounded and cut to [1, longest]; seeds are uniform over clips with edges; a step is drawn
    in proportion to the score (uniformly if all scores are 0) as the least exponential key. A walk without a way
    on stays shorter; walks below `least` steps are left. Each hop is written to the shared folder, so that lost
    executors cost one hop at most.
    """
    spark = edges.sparkSession
    ways_of = written(edges.select("source", "target", "transition_score"), "edges")
    seeds = ways_of.select(F.col("source").alias("clip_id")).distinct()
    seeds = dense_index(seeds, ["clip_id"], "k")
    total = seeds.count()
    u1, u2 = uniform(seed, F.lit("a"), F.col("chain_id")), uniform(seed, F.lit("b"), F.col("chain_id"))
    gauss = F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-300)))) * F.cos(2 * F.pi() * u2)
    length = F.greatest(F.lit(1), F.least(F.lit(longest), F.round(F.exp(mu + sigma * gauss)).cast("int")))
    start = F.floor(uniform(seed, F.lit("seed"), F.col("chain_id")) * max(total, 1))
    tracks = clips.select("clip_id", "track_id")
    state = spark.range(n).select(F.col("id").alias("chain_id")).withColumns({"length": length, "k": start}).join(seeds, "k").join(tracks, "clip_id")
    state = state.select("chain_id", "length", F.col("clip_id").alias("at"), F.array("clip_id").alias("seen"), F.array("track_id").alias("seen_tracks"))
    target = tracks.select(F.col("clip_id").alias("target"), F.col("track_id").alias("target_track"))
    ways = ways_of.join(target, "target")
    steps = None
    for turn in range(1, longest + 1):
        on = state.where(F.col("length") >= turn).join(ways, F.col("at") == F.col("source"))
        on = on.where(~F.array_contains("seen", F.col("target")) & ~F.array_contains("seen_tracks", F.col("target_track")))
        weight = F.greatest(F.col("transition_score"), F.lit(0.0))
        key = exponential_key(uniform(seed, F.col("chain_id"), F.lit(turn), F.col("target")), weight)
        best = F.min_by(F.struct("length", "source", "target", "transition_score", "seen", "seen_tracks", "target_track"), F.struct(key.alias("key"), "target"))
        step = on.groupBy("chain_id").agg(best.alias("s")).select("chain_id", F.lit(turn).alias("turn"), "s.*")
        step = written(step, "walk")
        state = step.select("chain_id", "length", F.col("target").alias("at"), F.array_append("seen", F.col("target")).alias("seen"), F.array_append("seen_tracks", F.col("target_track")).alias("seen_tracks"))
        row = step.select("chain_id", "turn", "source", "target", "transition_score")
        steps = row if steps is None else steps.unionByName(row)
    if least > 1:
        steps = steps.withColumn("_n", F.count("*").over(Window.partitionBy("chain_id"))).where(F.col("_n") >= least).drop("_n")
    return steps


def cumulative_state(steps: DataFrame) -> DataFrame:
    """added_cumulative and removed_cumulative after each turn: a tag is on the side of its last change so far.

    steps: chain_id, turn, tags_added, tags_removed (disjoint arrays). Turns stream through a task in order, and what is
    held is a chain's tags, not its moves.
    """

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, begun, last, sides = None, False, {}, ([], [])  # last: the turn of each tag's last change and on which sides it is

        def put(tag: str, turn, op: int) -> None:
            t, mask = last.get(tag, (None, 0))
            new = mask | 1 << op if t == turn else 1 << op
            for k in (0, 1):
                at = bisect_left(sides[k], tag) if (new ^ mask) >> k & 1 else 0
                if new >> k & 1 and not mask >> k & 1:
                    sides[k].insert(at, tag)
                elif mask >> k & 1 and not new >> k & 1:
                    del sides[k][at]
            last[tag] = (turn, new)

        for b in batches:
            start, many, out = 0, 0, ([], [])
            rows = zip(*(b.column(c).to_pylist() for c in ("chain_id", "turn", "tags_added", "tags_removed")), strict=True)
            for n, (c, turn, add, remove) in enumerate(rows, 1):
                if not begun or c != chain:
                    chain, begun, last, sides = c, True, {}, ([], [])
                for op, tags in ((1, add), (0, remove)):
                    for tag in tags or ():
                        put(tag, turn, op)
                out[1].append(sides[1].copy())
                out[0].append(sides[0].copy())
                many += len(last)
                if many > 200_000 or n == b.num_rows:  # long states in small batches
                    part = b.slice(start, n - start)
                    lists = [pa.array(out[k], pa.list_(pa.string())) for k in (1, 0)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*b.schema.names, "added_cumulative", "removed_cumulative"])
                    start, many, out = n, 0, ([], [])

    ordered = steps.repartition("chain_id").sortWithinPartitions("chain_id", "turn")
    more = T.StructType([*steps.schema.fields, *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("added_cumulative", "removed_cumulative"))])
    return ordered.mapInArrow(states, more)


def chain_records(steps: DataFrame, columns: list[str]) -> DataFrame:
    """One nested record for each chain: its length, seed and steps in order of turn."""
    inner = F.sort_array(F.collect_list(F.struct("turn", *columns)))
    return steps.groupBy("chain_id").agg(inner.alias("steps")).select("chain_id", F.size("steps").alias("chain_length"), F.element_at("steps", 1).alias("seed"), "steps")
