import corpus_pipeline as P
import oracle
import pytest
from llm_texts import ODD
from oracle import SF
from pyspark.sql import functions as F

from stepwright.llm import decontam, guesscost, langid, packing, simhash


def ids(df):
    return sorted(str(r[0]) for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark, tmp_path):
    """Each stage's rows follow from its operator's own decisions on its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and out.count() > 0
        if name == "language":
            assert ids(out) == ids(langid.identify(docs, langid.train(docs)).where("accepted"))
        elif name == "near_duplicates":
            gone = {r["doc_id"]: r["kept_doc_id"] for r in simhash.duplicates(docs).collect()}
            assert gone and set(ids(out)) == set(ids(docs)) - {str(i) for i in gone} and {str(i) for i in gone.values()} <= set(ids(out))
        elif name == "decontamination":
            hit = {str(r["doc_id"]) for r in decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert hit and set(ids(out)) == set(ids(docs)) - hit
        elif name == "secrets":
            assert ids(out) == ids(docs) and out.where(F.length("text") != F.col("n_chars")).count() == 0
            assert guesscost.findings(out).where("secret").count() == 0
        else:
            assert set(ids(out)) == set(ids(docs.where(packing.tokens() > 0)))
        docs = out


def test_run_equals_the_stages(spark):
    a = oracle.of_spark(P.run(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert oracle.difference(a, oracle.of_spark(docs)) == ""


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
    assert P.near_duplicates(spark, odd, SF).count() == len(ODD) - 1
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_near_duplicates_goes_by_all_pairs(spark):
    """Of pairs whose fingerprints differ by as much as is allowed, the first stays each time."""
    from test_simhash import brute, far_pairs

    rows = far_pairs(150)
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()}
    assert kept == {k for k, _ in rows} - {gone for gone, _ in brute(rows)}


def test_near_duplicates_meets_each_text_of_an_id(spark):
    """A document under an id that is there twice, with two texts: copies of either go."""
    from llm_texts import prose

    rows = [(1, prose(1, 90)), (1, prose(2, 90)), (5, prose(1, 90) + "!"), (6, prose(2, 90) + "!"), (7, prose(3, 90))]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(P.near_duplicates(spark, docs, SF)) == ["1", "1", "7"]


def test_run_leaves_what_the_result_needs(spark):
    from pathlib import Path

    from stepwright.llm import common

    root = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(root.glob("*"))
    P.run(spark, SF).count()
    left = [p for p in root.glob("*") if p not in before]
    assert sorted(p.name.partition("-")[0] for p in left) == ["lengths", "pieces", "pipeline"]
    assert [x.name for p in left if p.name.startswith("pipeline") for x in p.iterdir()] == ["secrets"]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    import types

    from stepwright.llm import common

    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}))
    with pytest.raises(RuntimeError):
        common.shared_dir(cluster)
