"""Ratings as a stream: append-only ingestion, latest rating by key, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stepwright.operators.keys import latest_values

_KINDS = {"rater": T.StringType(), "chain_id": T.LongType(), "turn": T.IntegerType(), "variant": T.IntegerType(), "field": T.StringType(), "score": T.IntegerType(), "rated_at": T.TimestampType(), "pos": T.LongType()}
RATING = T.StructType([T.StructField(k, v) for k, v in _KINDS.items()])
KEYS = ["rater", "chain_id", "turn", "variant", "field"]


def ingest(spark: SparkSession, folder: str, sink: str, checkpoint: str, schema: T.StructType = RATING, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append each new JSON line of a folder to a Parquet sink with received_at and a record_id that retries leave as it is."""
    rows = spark.readStream.schema(schema).json(folder)
    stamped = rows.withColumn("received_at", F.current_timestamp()).withColumn("record_id", F.sha1(F.to_json(F.struct(*schema.fieldNames()))))
    writer = stamped.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key, on a table or, with update output, on a stream: one aggregate, so both agree."""
    return latest_values(rows, keys, order, values)


def watermarked_counts(rows: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than `late` behind the newest are left out of a stream."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sync(rows: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep the last row of each key in a Parquet table: each batch is merged with the version before and written as a new one.

    A version's folder is named by the batch's number, so a batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        values = [c for c in batch.columns if c not in keys]
        both = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/v={number - 1}"))
        latest_values(both, keys, order, values).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def axis_counts(rows: DataFrame, axes: str, checkpoint: str, update: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Running counts of chosen axes: each batch's complete counts go to `update`."""
    counts = rows.select(F.explode(axes).alias("axis")).groupBy("axis").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
