"""The stages from tracks to gate over small tables, with stand-ins for the models."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright import config as C
from stepwright.plans import models as M
from stepwright.plans import stages as T
from stepwright.plans.runner import Runner


@pytest.fixture(scope="module")
def sources(spark):
    tracks = spark.createDataFrame([(f"t{k}", f"a{k % 7}" if k % 9 else "", ["Rock!", "rock", "Pop"], n, "vocal" if k % 2 else "") for k in range(40) for n in (1, 2)], "track_id string, artist_id string, tags array<string>, snapshot int, vocals string")
    captions = spark.createDataFrame([(f"t{k}", f"Caption {k // 2} here", float(k % 3), 9.0) for k in range(36)] * 2 + [("t39", " ", 0.0, 1.0)], "track_id string, caption string, start_time double, end_time double")
    rewrites = spark.createDataFrame([("t1", "short§§the longest one", 1), ("t2", "", 1), ("t1", "older", 0)], "track_id string, captions string, pos int")
    transcripts = spark.createDataFrame([], "clip_id string, transcript string, failed boolean")
    return {"tracks": tracks, "captions": captions, "rewrites": rewrites, "transcripts": transcripts, "clips": B.clips(spark, SF)}


def test_first_stages(spark, sources, tmp_path):
    r = Runner(spark, f"file://{tmp_path}", sources=sources)
    assert r.resume_at(["ingest", "caption_join"]) == "ingest"
    report = r.run_all([*"ingest caption_join lyrics structured_view".split(), T.embeddings(M.HashEmbedder(8))])
    assert report["ingest"] == {"manifest": "made", "dropped": "made"}
    m = r.table("manifest")
    assert m.count() == 36 == m.select("clip_id").distinct().count()
    assert m.groupBy("artist_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert m.select("tags").first()[0] == ["rock", "pop"]
    assert {x[0] for x in r.table("dropped").select("reason").collect()} == {"missing_caption"}
    c = {x["track_id"]: x for x in r.table("captioned").collect()}
    assert c["t1"]["rewritten_caption"] == "the longest one" and not c["t2"]["has_rewrite"]
    assert {x[0] for x in r.table("lyrics").select("lyrics_status").distinct().collect()} == {"empty", "non_vocal"}
    assert r.table("vectors").where("error IS NULL").count() == 36
    assert r.resume_at(["ingest", "caption_join"]) is None
    assert r.run("ingest") == {"manifest": "kept", "dropped": "kept"}
    assert Runner(spark, f"file://{tmp_path}", C.Config(ingest=C.Ingest(seed=14)), sources).resume_at(["ingest"]) == "ingest"


def test_later_stages(spark, sources, tmp_path):
    config = C.Config(neighborhood=C.Neighborhood(audio_top_k=30, retain=8, block_rows=64), chains=C.Chains(chains=50), instructions=C.Instructions(variants=2))
    r = Runner(spark, f"file://{tmp_path}", config, sources)
    r.run_all(["neighborhood", "graph", "chains", T.instructions(M.TemplateGenerator("Keep it but {verbosity} {tags_added}"))])
    nodes = [x[0] for x in r.table("nodes").orderBy("clip_id").select("node_idx").collect()]
    assert nodes == [*range(len(nodes))]
    steps = r.table("steps")
    assert steps.groupBy("chain_id").agg((F.max("turn") - F.count("*")).alias("gap")).where("gap <> 0").count() == 0
    assert r.table("chains").select(F.sum("chain_length")).first()[0] == steps.count()
    assert r.table("instructions").count() == 2 * steps.count()
    clips = sources["clips"].withColumn("lyrics", F.lit(""))
    pools = T.relevance_pool({"steps": steps, "edges": r.table("edges"), "clips": clips}, C.Pool(candidates=8))
    pool = pools["pool"]
    assert pool.where("is_target").count() == steps.count() == pools["summary"].count()
    assert pool.groupBy("step").count().agg(F.max("count")).first()[0] <= 8
    assert pools["reasons"].where("reason_code = 'success:target'").count() == steps.count()
    later = {x["step"]: x for x in T.pool_steps(steps, clips).collect()}
    by_chain = {}
    for x in steps.orderBy("chain_id", "turn").collect():
        by_chain.setdefault(x["chain_id"], []).append(x)
    for chain, rows in by_chain.items():
        for k, x in enumerate(rows):
            s = later[chain, x["turn"]]
            assert (s["seed"], s["prior"]) == (rows[0]["source"], [y["target"] for y in rows[:k]]) and set(s["references"]) <= set(s["prior"][:-1] if k else [])
    v = T.validation({"instructions": r.table("instructions")}, C.Validation())["validated"]
    assert v.where("accepted").count() <= v.count() and set(v.columns) >= {"unaware_reasons", "aware_reasons", "accepted"}
    ratings = r.table("instructions").select("chain_id", "turn", "variant", (3 + F.col("variant")).alias("score"))
    out = T.gate({"ratings": ratings}, C.Gate())
    assert out["selected"].count() == steps.count() and out["graded"].where("best_variant <> 1").count() == 0


def test_unknown_table(spark, tmp_path):
    with pytest.raises(KeyError):
        Runner(spark, f"file://{tmp_path}").run("graph")


def test_audio_models(spark):
    class Listener:
        def open(self):
            pass

        def listen(self, audio):
            return [f"{len(x)} bytes" for x in audio]

        def encode_audio(self, audio):
            return [[3.0, 4.0 * len(x)] for x in audio]

    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"")], "k int, audio binary")
    got = {r["k"]: (r["caption"], r["error"] is None) for r in M.heard(df, "audio", Listener(), "caption").collect()}
    assert got == {1: ("3 bytes", True), 2: (None, False), 3: ("0 bytes", True)}
    got = {r["k"]: r["vector"] for r in M.embedded_audio(df.where("k = 3"), "audio", Listener()).collect()}
    assert got == {3: [1.0, 0.0]}


def test_backend_rules():
    name = lambda *a, **k: (M.backend(*a, **k)["backend"], M.backend(*a, **k)["quantization"])
    assert M.parameters_b("Qwen3-35B-A3B") == 35 and M.parameters_b("none") is None and M.parameters_b("x7b") is None
    assert name("m-7b", []) == ("transformers", None) and name("m", [80.0]) == ("vllm", None)
    assert M.backend("m-30b", [80.0])["reason"] == "bf16_fits_single_gpu"
    # The smallest of several GPUs decides.
    assert M.backend("m-30b", [80.0, 24.0])["reason"] == "bf16_fits_tensor_parallel" and M.backend("m-30b", [80.0, 24.0])["tensor_parallel_size"] == 2
    assert name("m-70b", [80.0], ("NVIDIA H100",)) == ("vllm", "fp8")
    assert name("qwen-70b", [80.0], allow_sglang=True) == ("sglang_local", None)
    assert M.backend("m-70b", [80.0], ("A100",))["reason"].startswith("single") and M.backend("m-70b", [80.0])["reason"].startswith("conservative")


def test_shared_folder_must_be_named_on_a_cluster():
    import types

    from stepwright import storage

    with pytest.raises(RuntimeError):
        storage.shared_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(master="yarn", getConf=lambda: {})))
