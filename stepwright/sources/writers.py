"""Sinks. Parquet is canonical; CSV, JSON lines and text are for interchange. Each write is committed as a whole."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.text import strip
from stepwright.operators.keys import latest_by


def write_csv(df: DataFrame, path: str, columns: list[str], null: str | None = None) -> None:
    """The given columns in this order, with a header; arrays and structs as JSON text; white space at a cell's ends stays.

    A null is an empty cell, or the mark null if given: it begins with a backslash, and cells that do so get one more.
    """
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}

    def cell(c: str) -> Column:
        v = F.to_json(c) if c in nested else F.col(c)
        if null is not None:
            v = F.when(v.isNull(), null).when(v.cast("string").startswith("\\"), F.concat(F.lit("\\"), v.cast("string"))).otherwise(v.cast("string"))
        return v.alias(c)

    out = df.select(*map(cell, columns)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merge_records(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record for each key, the last in the given order."""
    return latest_by(df, keys, order)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """records, distinct keys and duplicates, as one row."""
    n = F.count_distinct(F.struct(*keys))
    return df.agg(F.count("*").alias("records"), n.alias("keys"), (F.count("*") - n).alias("duplicates"))


def detected_lines(df: DataFrame, key: Column, parts: list[Column]) -> DataFrame:
    """df with line: `key (part, part)`, blank parts left out."""
    inside = F.concat_ws(", ", *(F.nullif(strip(p), F.lit("")) for p in parts))
    return df.withColumn("line", F.concat(key.cast("string"), F.lit(" ("), inside, F.lit(")")))


def write_adjacency(edges: DataFrame, path: str, shards: int = 4096) -> None:
    """Edges in folders by source modulo shards, sorted by source and rank: a reader prunes to one folder."""
    s = edges.withColumn("shard", F.pmod("source", F.lit(shards)))
    s.repartition("shard").sortWithinPartitions("shard", "source", "rerank_rank").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_adjacency(spark, path: str, sources: list[int], shards: int = 4096) -> DataFrame:
    """Edges of the given sources; the filter on the shard prunes the folders that are read."""
    return spark.read.parquet(path).where(F.col("shard").isin(sorted({s % shards for s in sources})) & F.col("source").isin(sources))


def report(df: DataFrame, **metrics: Column) -> dict:
    """A stage's counters, computed in one pass, as a dictionary that json can store."""
    row = df.agg(*(c.alias(k) for k, c in metrics.items())).first()
    return json.loads(json.dumps(row.asDict(), default=str))


def sidecar(assignments: DataFrame, steps: DataFrame, manifest: DataFrame, keys: list[str], clip: str) -> DataFrame:
    """Assignments with their steps nested, and the manifest rows that the steps name: one frozen document for each assignment."""
    s = steps.join(manifest.withColumnRenamed("clip_id", clip), clip, "left")
    others = [c for c in s.columns if c not in keys]
    nested = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("steps"))
    return assignments.join(nested, keys, "left")


def write_npy(df: DataFrame, folder: str, name: str, vector: str) -> DataFrame:
    """Write each row's vector (32-bit floats) to folder/<name>.npy; one row of name, path and error for each.

    A file is written under a name of its own and moved in place, so that it is whole whenever it is there, and a task
    that is run again writes the same. folder must be in the shared file system. Null names or vectors are errors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            paths, errors = [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not key or v is None:
                    paths.append(None)
                    errors.append("no name" if not key else "no vector")
                    continue
                out = io.BytesIO()
                np.save(out, np.asarray(v, np.float32), allow_pickle=False)
                at = f"{root}/{key}.npy"
                part = f"{at}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(out.getvalue())
                system.move(part, at)
                paths.append(f"{folder.rstrip('/')}/{key}.npy")
                errors.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["name", "path", "error"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(vector).cast("array<float>").alias("vector")).mapInArrow(run, "name string, path string, error string")
