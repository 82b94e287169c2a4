"""Streams (inventory 2.15) and model boundaries (2.16): events replayed as a stream, stub models over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepwright import bindings as B
from stepwright.plans import models
from stepwright.queries.registry import query
from stepwright.storage import shared_dir
from stepwright.streaming import ratings as R


def _stream(spark, sf):
    schema = B.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


def _collected(spark, rows, mode):
    """Run a stream to its end into the shared folder, and read the last state of it."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    names = rows.columns
    kinds = rows.schema

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        last = spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0]
        return spark.read.schema(kinds).parquet(f"{base}/out/batch={last}").select(*names)
    return spark.read.parquet(f"{base}/out").select(*names)


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_latest_rating(spark, sf):
    return _collected(spark, R.latest(_stream(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]), "complete")


@query("SELECT event_id, user_id, sha1(event_id || ':' || user_id) AS record_id FROM events")
def stream_append(spark, sf):
    e = _stream(spark, sf)
    return _collected(spark, e.select("event_id", "user_id", F.sha1(F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string"))).alias("record_id")), "append")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    e = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.watermarked_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT tag AS axis, count(*) AS n FROM (SELECT unnest([event_type, 'all']) AS tag FROM events) GROUP BY tag")
def stream_axis_counts(spark, sf):
    e = _stream(spark, sf).select(F.explode(F.array("event_type", F.lit("all"))).alias("axis")).groupBy("axis").agg(F.count("*").alias("n"))
    return _collected(spark, e, "complete")


@query()
def embed_stub(spark, sf):
    """Unit vectors of documents by the stub embedder, with failures as a column."""
    return models.embedded(B.table(spark, sf, "documents").select("doc_id", "text"), "text", models.HashEmbedder(16))


@query("SELECT conv_id, turn, 'Keep the ' || role || ' but more.' AS instruction, CAST(NULL AS VARCHAR) AS error FROM conversations")
def generate_stub(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role")).alias("prompt"))
    return models.generated(c, "prompt", models.TemplateGenerator("Keep the {role} but more."), "instruction").select("conv_id", "turn", "instruction", "error")


@query("SELECT conv_id, turn, CAST(1 + length(text) % 5 AS INTEGER) AS score FROM conversations")
def judge_stub(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.length("text").alias("n"))).alias("prompt"))
    answer = models.generated(c, "prompt", models.LengthJudge(), "answer")
    return answer.select("conv_id", "turn", F.from_json("answer", "score int")["score"].alias("score"))
