"""The stages as DataFrame -> DataFrame functions, and their registry.

Each stage takes the tables that it needs by name and its part of the Config, and returns the tables that it makes.
Nothing is computed here: a stage is a plan, and whoever writes a table runs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright import config as C
from stepwright.functions import labels as L
from stepwright.functions import sampling as S
from stepwright.functions import text as X
from stepwright.operators import deltas as D
from stepwright.operators import gate as G
from stepwright.operators import graph as W
from stepwright.operators import ingest as I
from stepwright.operators import joins as N
from stepwright.operators import keys as K
from stepwright.operators import pools as P
from stepwright.operators import vectors as V
from stepwright.plans import models as M

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A stage's tables: what it reads, what it makes (the first one says whether it is done), its function and its part of the Config."""

    name: str
    reads: tuple[str, ...]
    makes: tuple[str, ...]
    run: Callable[[Tables, object], Tables]
    part: str


STAGES: dict[str, Stage] = {}


def stage(reads: str, makes: str, part: str | None = None):
    def register(f):
        STAGES[f.__name__] = Stage(f.__name__, tuple(reads.split()), tuple(makes.split()), f, part or f.__name__)
        return f

    return register


@stage("tracks captions", "manifest dropped")
def ingest(t: Tables, c: C.Ingest) -> Tables:
    """tracks (track_id, artist_id, tags, snapshot, ...) and captions (track_id, caption, start_time, end_time) to one row a clip.

    Of repeated snapshots of a track the last counts; captions are numbered by their times before repeats are dropped;
    rows are dropped with a reason; whole artists go to one split.
    """
    latest = K.latest_by(t["tracks"], ["track_id"], ["snapshot"]).drop("snapshot")
    said = t["captions"].where((X.strip(F.col("track_id")) != "") & (F.length(X.strip(F.col("caption"))) >= c.min_caption_chars))
    said = K.distinct_with_ordinal(said, ["track_id"], ["start_time", "end_time", "caption"], "caption")
    rows = N.captioned(latest, said, "track_id", keep_missing=True)
    rows = rows.withColumn("tags", X.dedupe(F.transform("tags", X.normalise_tag)))
    reason = I.drop_reason(F.col("caption"), F.col("tags"), F.lit(True), c.drop_missing_caption, c.drop_missing_tags, c.drop_missing_audio)
    rows = rows.withColumn("reason", reason)
    kept = rows.where(F.col("reason").isNull()).drop("reason")
    split = I.group_split(kept.select("track_id", "artist_id").distinct(), "artist_id", c.seed, c.train, c.val).select("track_id", "split")
    key = L.clip_key(F.col("track_id"), F.col("start_time"), F.col("end_time"), F.col("ordinal"))
    return {"manifest": kept.join(split, "track_id").withColumn("clip_id", key), "dropped": rows.where(F.col("reason").isNotNull()).select("track_id", "reason")}


@stage("manifest rewrites", "captioned")
def caption_join(t: Tables, c: C.CaptionJoin) -> Tables:
    """manifest with the rewritten captions of each track, its primary one by the strategy."""
    r = K.latest_by(t["rewrites"], ["track_id"], ["pos"]).withColumn("rewrite", X.primary(X.split_on(F.col("captions"), c.separator), c.strategy))
    return {"captioned": N.with_rewrites(t["manifest"], r, "track_id", "rewrite", "caption", c.keep_unmatched, c.overwrite)}


@stage("manifest transcripts", "lyrics")
def lyrics(t: Tables, c: C.Lyrics) -> Tables:
    """manifest with lyrics state of each clip. transcripts: clip_id, transcript, failed (a transcriber's answers)."""
    rows = t["manifest"].join(t["transcripts"], "clip_id", "left")
    state = I.lyric_state(F.col("vocals"), F.col("transcript"), F.coalesce("failed", F.lit(False)), c.allowed_vocals if c.only_vocal else ("vocal", "instrumental", ""))
    return {"lyrics": rows.withColumn("_s", state).withColumns({"lyrics_status": F.col("_s.status"), "lyrics": F.col("_s.lyrics"), "lyrics_error": F.col("_s.error")}).drop("_s", "transcript", "failed")}


@stage("manifest", "view", "structured_view")
def structured_view(t: Tables, c: C.StructuredView) -> Tables:
    """One typed row a clip, with normalised captions and, if asked for, only the most frequent tags."""
    m = t["manifest"]
    if c.top_tags is not None:
        m = I.keep_vocabulary(m, "tags", I.vocabulary(m, "tags", c.top_tags))
    caption = X.normalise_caption(F.col("caption"), c.strip_outer)
    return {"view": m.withColumns({"normalized_caption": caption, "caption_char_len": F.length(X.text(F.col("caption"))), "caption_word_len": X.word_count(F.col("caption")), "tag_count": F.size("tags")})}


def embeddings(model: M.Embedder) -> Stage:
    """A stage that embeds the view's captions with this model; clips that `vectors_before` has are not embedded again."""

    def run(t: Tables, c: C.Embeddings) -> Tables:
        todo = t["view"].select("clip_id", X.combined(F.col("caption"), F.lit("")).alias("input"))
        before = t.get("vectors_before")
        if before is None or c.overwrite:
            return {"vectors": M.embedded(todo, "input", model, c.batch, c.truncate)}
        made = M.embedded(N.pending(todo, before.where("error IS NULL"), "clip_id"), "input", model, c.batch, c.truncate)
        return {"vectors": before.where("error IS NULL").unionByName(made)}

    return Stage("embeddings", ("view",), ("vectors",), run, "embeddings")


@stage("clips", "nodes edges")
def neighborhood(t: Tables, c: C.Neighborhood) -> Tables:
    """clips (clip_id, track_id, split, tags, audio, text_vec) to numbered nodes and each clip's best neighbours."""
    near = V.knn_blocks(t["clips"], c.audio_top_k, "audio", c.block_rows, c.least_similarity, c.exclude_same_track)
    edges = V.rerank(near, t["clips"], c.audio_weight, c.text_weight, c.most_changed_tags, c.retain)
    return {"nodes": K.dense_index(t["clips"].select("clip_id", "track_id"), ["clip_id"], "node_idx"), "edges": edges}


@stage("edges", "transitions adjacency")
def graph(t: Tables, c: C.Graph) -> Tables:
    scored = W.transitions(t["edges"], c.most_changed_tags, c.weights)
    return {"transitions": scored, "adjacency": W.adjacency(scored)}


@stage("transitions clips", "chains steps")
def chains(t: Tables, c: C.Chains) -> Tables:
    """Random walks, and for each of their steps the tag changes so far; one nested record a chain."""
    walked = W.walks(t["transitions"], t["clips"], c.chains, c.longest, c.shortest, c.seed, c.mu, c.sigma)
    how = t["transitions"].select("source", "target", "hardness", "tags_added", "tags_removed", "tags_preserved")
    steps = W.cumulative_state(walked.join(how, ["source", "target"]))
    return {"chains": W.chain_records(steps, [x for x in steps.columns if x not in ("chain_id", "turn")]), "steps": steps}


def instructions(model: M.Generator) -> Stage:
    """A stage that asks this model for each step's instruction, with the step's verbosity and number of clauses."""

    def run(t: Tables, c: C.Instructions) -> Tables:
        key = (F.col("chain_id"), F.col("turn"))
        s = t["steps"].withColumns({"verbosity": S.verbosity(S.uniform(c.seed, F.lit("verbosity"), *key), *c.verbosity), "clauses": S.clause_total(S.uniform(c.seed, F.lit("clauses"), *key), c.clauses, c.most_clauses)})
        s = s.select(*key, "verbosity", "clauses", "tags_added", "tags_removed", "tags_preserved", F.explode(F.sequence(F.lit(0), F.lit(c.variants - 1))).alias("variant"))
        s = s.withColumn("prompt", F.to_json(F.struct("variant", "verbosity", "clauses", "tags_added", "tags_removed", "tags_preserved")))
        out = M.generated(s, "prompt", model, "instruction")
        style = L.style_error(F.col("instruction"), F.col("verbosity"))
        return {"instructions": out.withColumn("error", F.coalesce("error", style))}

    return Stage("instructions", ("steps",), ("instructions",), run, "instructions")


@stage("instructions", "validated")
def validation(t: Tables, c: C.Validation) -> Tables:
    """The precheck's reasons against each instruction, read without and with its history, and whether it is accepted."""
    none = F.array().cast("array<string>")
    change = F.concat("tags_added", "tags_removed")
    check = lambda aware: D.precheck(F.col("instruction"), change, F.lit(False), aware, F.lit(False), none, none, c.min_chars)
    v = t["instructions"].withColumns({"unaware_reasons": check(False), "aware_reasons": check(True)})
    return {"validated": v.withColumn("accepted", F.col("error").isNull() & G.accept_both(F.size("unaware_reasons") == 0, F.size("aware_reasons") == 0, c.require_both))}


@stage("ratings", "graded selected", "gate")
def gate(t: Tables, c: C.Gate) -> Tables:
    """ratings (chain_id, turn, variant, score) to graded steps and to the records that pass the contextual policy."""
    graded = G.grade(t["ratings"], "score", c.threshold, c.policy, c.mean_chain_score)
    return {"graded": graded, "selected": G.select(graded, c.contextual)}


def pool_steps(steps: DataFrame, clips: DataFrame, most_references: int = 2) -> DataFrame:
    """The chains' steps (chain_id, turn, source, target) as P.scored() and P.candidate_sources() want them.

    step is the chain and the turn; seed is the source of a chain's first turn, prior its targets so far; references are
    the earlier targets with most in common; terms are the constraints of the step's change of tags, vocals and speed.
    """
    w = Window.partitionBy("chain_id").orderBy("turn")
    key = F.struct("chain_id", "turn").alias("step")
    c = clips.select("clip_id", F.struct("tags", "vocals", "speed", F.array_distinct(X.content_tokens(X.combined(F.col("caption"), F.col("lyrics")))).alias("terms")).alias("c"))
    s = steps.select("chain_id", "turn", "source", "target", F.first("source").over(w).alias("seed"), F.collect_list("target").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"))
    s = s.join(c.select(F.col("clip_id").alias("source"), F.col("c").alias("s")), "source").join(c.select(F.col("clip_id").alias("target"), F.col("c").alias("t")), "target")
    h = D.history_references(s.select("chain_id", "turn", "t.tags", "t.terms"), most_references).groupBy("chain_id", "turn").agg(F.sort_array(F.collect_list(F.struct("place", "prior_turn"))).alias("h"))
    b = D.buckets(F.col("s.tags"), F.col("t.tags"), F.col("s.vocals"), F.col("t.vocals"), F.col("s.speed"), F.col("t.speed"))
    s = s.join(h, ["chain_id", "turn"], "left")
    # The target of turn k is the k-th of the earlier targets.
    references = F.coalesce(F.transform("h", lambda x: F.element_at("prior", x["prior_turn"].cast("int"))), F.filter("prior", lambda x: F.lit(False)))
    return s.select(key, "source", "target", "seed", "prior", references.alias("references"), F.struct(b["added"].alias("new"), b["lost"].alias("lost"), b["persistent"].alias("kept")).alias("terms"))


@stage("steps edges clips", "pool summary reasons", "pool")
def relevance_pool(t: Tables, c: C.Pool) -> Tables:
    """steps, the neighbourhoods' edges and clips (with caption, lyrics, vocals and speed) to each step's pool, its counts and the reasons of all its candidates."""
    steps = pool_steps(t["steps"], t["clips"])
    candidates = P.merge_candidates(P.candidate_sources(steps, t["edges"]), c.candidates)
    rows = P.scored(candidates, steps, P.prepared(t["clips"]))
    rows = rows.select("step", "clip", "ordinal", "labels", "pool_type", "grade", "failure_category", "failed", "satisfied", "final", "alignment", "to_target", "to_source", "split", "is_target")
    pool = P.select_pool(rows, c.candidates)
    reasons = rows.select("step", "clip", P.reason_code(F.col("pool_type"), F.col("failure_category")).alias("reason_code"), "grade")
    return {"pool": pool, "summary": P.summarise(pool), "reasons": reasons}
