"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm import chatwin, decontam, guesscost, langid, licenses, packing, simhash, svbyte, telephony, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a crawler stores them (chunked framing, segments), put together again."""
    pages = _table(spark, sf_dir, "pages")
    whole = warc.reassemble(warc.records_of_pages(pages))
    return whole.select(F.substring_index("record_id", ":", -1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), "segments", "length", "status", "http_status", F.decode("body", "utf-8").alias("html"))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def calls(conversations: DataFrame) -> DataFrame:
    """A call for each turn: its text's bytes are taken as codec bytes; the codec goes by the turn's number."""
    codec = F.element_at(F.array(F.lit("mulaw"), F.lit("alaw"), F.lit("adpcm")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    return conversations.select("conv_id", "turn", codec.alias("codec"), F.encode("text", "utf-8").alias("payload"))


def op3_telephony_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.to_pcm(calls(_table(spark, sf_dir, "conversations")), ["conv_id", "turn"])


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognised(_table(spark, sf_dir, "documents"))


def op5_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svbyte.encoded(_table(spark, sf_dir, "documents"))


def op6_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(_table(spark, sf_dir, "documents"))


def op7_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guesscost.findings(_table(spark, sf_dir, "documents"))


def op8_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatwin.formatted(_table(spark, sf_dir, "conversations"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc_reassembly, op2_bestfit_packing, op3_telephony_pcm, op4_license_rules, op5_ranked_ids, op6_simhash_duplicates, op7_secret_guess_cost, op8_benchmark_matches, op9_chat_windows, op10_language)
    return {f.__name__: f for f in own}


_HEAD = len(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n")


def oracle_sql() -> dict[str, str]:
    chunk, segment = warc.CHUNK_BYTES, warc.SEGMENT_BYTES
    # A chunk of k bytes takes k, the hexadecimal digits of k and two line ends; the last chunk is 0 and two line ends.
    op1 = f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages WHERE page_id IS NOT NULL),
    q AS (SELECT *, {_HEAD} + n + (n // {chunk}) * {len(f"{chunk:x}") + 4}
                  + CASE WHEN n % {chunk} > 0 THEN length(printf('%x', n % {chunk})) + 4 ELSE 0 END + 5 AS total FROM p)
    SELECT page_id, url, CAST((total + {segment - 1}) // {segment} AS INTEGER) AS segments, CAST(total AS BIGINT) AS length,
           'ok' AS status, CAST(200 AS INTEGER) AS http_status, html FROM q"""
    return {"op1_warc_reassembly": op1, "op4_license_rules": licenses.oracle_sql(), "op9_chat_windows": chatwin.oracle_sql()}
