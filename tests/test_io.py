"""Readers, writers, streams and model boundaries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.plans import models as M
from stepwright.sources import readers as R
from stepwright.sources import writers as W
from stepwright.streaming import ratings as S


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\nnot json\n[1]\n')
    assert [tuple(r) for r in R.read_jsonl(spark, str(p), "a int, b string", lenient=True).collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_jsonl(spark, str(p), "a int, b string").collect()
    assert R.read_jsonl_or_empty(spark, str(tmp_path / "none"), "a int").collect() == []
    (tmp_path / "y.jsonl").write_text("")
    (tmp_path / "z.txt").write_text("")
    assert [x.rsplit("/", 1)[1] for x in R.discover_shards(spark, str(tmp_path), exclude=("y.jsonl",))] == ["x.jsonl"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', ["a"]), (2, "two\nlines", []), (3, None, None)], "id int, t string, tags array<string>")
    W.write_csv(df, str(tmp_path / "c"), ["t", "id", "tags"])
    got = R.read_csv(spark, str(tmp_path / "c"))
    assert got.columns == ["t", "id", "tags"]
    assert sorted(tuple(r) for r in got.collect()) == sorted([('say "hi", you', "1", '["a"]'), ("two\nlines", "2", "[]"), ("", "3", "")])


def test_csv_round_trip_odd_texts_by_sql(spark, tmp_path):
    """Blanks at the ends, empty and null cells, backslashes, carriage returns: as the SQL has them."""
    import duckdb
    import oracle

    from stepwright import catalog

    texts = ["plain", " lead", "trail ", "\t", "  ", "", None, "a\r\nb", "\r", "\n", "a\nb\n", '"', '""', "a\\", '\\"', r"\N", r"\\N", "\\", "#c", "null", "x" * 200_000]
    df = spark.createDataFrame([(k, t, "en" if k != 3 else None, "web") for k, t in enumerate(texts)] + [(None, "no id", "fr", "web")], "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = oracle.of_spark(catalog.queries()["csv_round_trip"](spark, str(tmp_path)))
    assert oracle.difference(got, oracle.of_sql(con, catalog.oracle_sql()["csv_round_trip"])) == ""


def test_ragged_tsv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ID\tNAME\tTAGS\n1\tone\ta\tb\t \tc\n2\n")
    assert [tuple(r) for r in R.read_ragged_tsv(spark, str(tmp_path / "t.tsv"), ["ID", "NAME", "TAGS"]).collect()] == [("1", "one", "a b c"), ("2", "", "")]
    with pytest.raises(ValueError, match="does not begin"):
        R.read_ragged_tsv(spark, str(tmp_path / "t.tsv"), ["X", "NAME", "TAGS"])


def test_npy_and_names(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float64).reshape(2, 3))
    (tmp_path / "b.npy").write_bytes(b"no array")
    got = {r["path"].rsplit("/", 1)[1]: r["vector"] for r in R.read_npy(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "b.npy": None}
    folder = tmp_path / "side"
    folder.mkdir()
    (folder / "c1__turn_2__variant_0__0af3.json").write_text("{}")
    (folder / "other.json").write_text("{}")
    assert sorted((r["chain"] or "", r["turn"]) for r in R.scan_sidecars(spark, str(folder)).collect()) == [("", None), ("c1", 2)]
    link = spark.createDataFrame([('<http://x/2>; rel="next", <http://x/9>; rel="last"',), ("",), (None,)], "h string")
    assert [r[0] for r in link.select(R.next_link(F.col("h"))).collect()] == ["http://x/2", None, None]


def test_adjacency_is_pruned(spark, tmp_path):
    e = spark.createDataFrame([(k, k + 1, 1) for k in range(40)], "source long, target long, rerank_rank int")
    W.write_adjacency(e, str(tmp_path / "adj"), 8)
    got = W.read_adjacency(spark, str(tmp_path / "adj"), [3, 11], 8)
    assert sorted((r["source"], r["target"]) for r in got.collect()) == [(3, 4), (11, 12)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def rating(rater, variant, score, at, pos):
    return json.dumps({"rater": rater, "chain_id": 1, "turn": 1, "variant": variant, "field": "f", "score": score, "rated_at": at, "pos": pos})


def test_ratings_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([rating("a", 0, 3, "2026-01-01T00:00:00Z", 1), rating("b", 0, 4, "2026-01-01T00:00:00Z", 2)]))
    S.ingest(spark, src, out, state).awaitTermination()
    S.sync(spark.readStream.schema(S.RATING).json(src), str(tmp_path / "latest"), str(tmp_path / "s2"), S.KEYS, ["rated_at", "pos"]).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join([rating("a", 0, 5, "2026-01-02T00:00:00Z", 3), rating("a", 0, 1, "2025-01-02T00:00:00Z", 4)]))
    S.ingest(spark, src, out, state).awaitTermination()
    S.ingest(spark, src, out, state).awaitTermination()  # nothing new: nothing twice
    rows = spark.read.parquet(out)
    assert rows.count() == 4 == rows.select("record_id").distinct().count()
    S.sync(spark.readStream.schema(S.RATING).json(src), str(tmp_path / "latest"), str(tmp_path / "s2"), S.KEYS, ["rated_at", "pos"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "latest" / "v=1"))
    assert sorted((r["rater"], r["score"]) for r in got.collect()) == [("a", 5), ("b", 4)]
    batch = S.latest(rows, S.KEYS, ["rated_at", "pos"], ["score"])
    assert sorted((r["rater"], r["score"]) for r in batch.collect()) == [("a", 5), ("b", 4)]


def test_models_retry_row_by_row(spark):
    class Picky:
        def open(self):
            pass

        def answer(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("cannot")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(k, "bad" if k == 7 else f"p{k}") for k in range(40)], "id int, prompt string")
    got = {r["id"]: (r["answer"], r["error"]) for r in M.generated(df, "prompt", Picky(), "answer", batch=8).collect()}
    assert got[7] == (None, "RuntimeError: cannot") and all(got[k] == (f"P{k}", None) for k in range(40) if k != 7)
    v = M.embedded(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t", M.HashEmbedder(8), truncate=4).collect()
    assert all(len(r["vector"]) == 4 and r["error"] is None for r in v)


def test_backend_rule():
    assert M.parameters_b("some-27B-it-fp8") == 27 and M.parameters_b("none") is None
    assert M.backend("x-7b", [24.0])["reason"] == "bf16_fits_single_gpu" and M.backend("x-70b", [])["backend"] == "transformers"


def test_write_npy(spark, tmp_path):
    from stepwright.sources.readers import read_npy
    from stepwright.sources.writers import write_npy

    df = spark.createDataFrame([("a", [1.0, 2.5]), ("b", []), (None, [1.0]), ("c", None), ("a", [1.0, 2.5])], "k string, v array<double>")
    done = write_npy(df, f"file://{tmp_path}/vectors", "k", "v").collect()
    assert sorted((r["name"] or "", r["error"] or "") for r in done) == [("", "no name"), ("a", ""), ("a", ""), ("b", ""), ("c", "no vector")]
    assert sorted(p.name for p in (tmp_path / "vectors").iterdir()) == ["a.npy", "b.npy"]
    got = {r["path"].rsplit("/", 1)[1]: r["vector"] for r in read_npy(spark, f"{tmp_path}/vectors").collect()}
    assert got == {"a.npy": [1.0, 2.5], "b.npy": []}


def test_listing_and_download(tmp_path):
    from stepwright.sources import listing

    answers = {"u/1": ({"link": '<u/2>; rel="next", <u/9>; rel="last"'}, [b"a", b"b"]), "u/2": ({"Link": "<u/1>; rel=next"}, [b"c"]), "u/f.jsonl": ({}, [b"x\n", b"y\n"])}
    asked = []

    def fetch(url):
        asked.append(url)
        headers, chunks = answers[url]
        return headers, iter(chunks)

    assert list(listing.pages("u/1", fetch)) == [b"ab", b"c"] and asked == ["u/1", "u/2"]
    at = str(tmp_path / "f.jsonl")
    assert listing.download("u/f.jsonl", at, fetch=fetch) and open(at, "rb").read() == b"x\ny\n"
    assert not listing.download("u/f.jsonl", at, fetch=fetch) and asked.count("u/f.jsonl") == 1
    with pytest.raises(ValueError):
        listing.download("u/f.jsonl", str(tmp_path / "f.csv"), fetch=fetch)

    def broken(url):
        def chunks():
            yield b"x"
            raise OSError("lost")

        return {}, chunks()

    with pytest.raises(OSError):
        listing.download("u/g.jsonl", str(tmp_path / "g.jsonl"), fetch=broken)
    assert not (tmp_path / "g.jsonl").exists()
