"""Scans. Columns are read as declared; what the data model calls missing is the empty string."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions.text import text


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, lenient: bool = False) -> DataFrame:
    """JSON lines. Strict: a malformed line fails the read. Lenient: malformed lines and lines that are no object are left out."""
    if not lenient:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*").where(F.col("_corrupt").isNull()).drop("_corrupt")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_jsonl; a path that is not there is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, separator: str = ",", null: str | None = None) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks inside cells; all columns strings, null as empty.

    null: the mark of write_csv() for nulls, which then come back as such.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", separator)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    rows = reader.csv(path).na.fill("")
    if null is None:
        return rows
    cell = lambda c: F.when(F.col(f"`{c}`") != null, F.regexp_replace(f"`{c}`", r"^\\", "")).alias(c)
    return rows.select(*map(cell, rows.columns))


def read_ragged_tsv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Tab-separated lines with a fixed header; the last column takes all further cells, joined by spaces.

    The header line is checked against `header` and left out; short lines are filled up with empty cells.
    """
    n = len(header)
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].split("\t")[:n] != header:
        raise ValueError(f"{path} does not begin with the columns {header}")
    cells = F.split("value", "\t")
    rest = F.array_join(F.filter(F.slice(cells, n, 1 << 20), lambda x: F.trim(x) != ""), " ")
    lines = spark.read.text(path).where(F.col("value") != "\t".join(header))
    return lines.select(*(text(F.try_element_at(cells, F.lit(k + 1))).alias(header[k]) for k in range(n - 1)), rest.alias(header[-1]))


def discover_shards(spark: SparkSession, folder: str, suffix: str = ".jsonl", exclude: tuple[str, ...] = (), most: int | None = None) -> list[str]:
    """Sorted paths of a folder's files with the suffix, without the excluded names; the first `most` of them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    paths = sorted(f.getPath().toString() for f in found if f.isFile() and f.getPath().getName().endswith(suffix) and f.getPath().getName() not in exclude)
    return paths[:most] if most is not None else paths


def next_link(header: Column) -> Column:
    """The target of rel="next" in a Link header, null if there is none."""
    return F.nullif(F.regexp_extract(text(header), r'<([^>]+)>\s*;\s*rel="?next"?', 1), F.lit(""))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path and vector (array<float>) of .npy files, flattened; files that are no array have a null vector."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    out.append(np.load(io.BytesIO(data), allow_pickle=False).astype(np.float32).ravel().tolist())
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["path", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, vector array<float>")


def sidecar_key(path: Column) -> Column:
    """struct(chain, turn, variant) of a name chain__turn_N__variant_M__digest.json; null for another name."""
    name = F.substring_index(path, "/", -1)
    pattern = r"^(.*)__turn_(\d+)__variant_(\d+)__[a-f0-9]+[.]json$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("chain"), part(2).try_cast("int").alias("turn"), part(3).try_cast("int").alias("variant")))


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """chain, turn, variant of a folder's record files, from their names alone: contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    return files.select("path", sidecar_key(F.col("path")).alias("k")).select("path", "k.*")


def license_blocks(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """path, title, artist, link, license of three-line blocks: a path, `title by artist from ...: link`, a licence."""
    lines = df.select(*keys, F.posexplode(F.split(content, r"\r?\n")).alias("pos", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pos")
    block = lines.withColumns({"_two": F.lead("line", 1).over(w), "_three": F.lead("line", 2).over(w)})
    pattern = r"^(.*) by (.*) from [^:]*: (\S+)$"
    hit = block.where(F.col("_two").rlike(pattern) & F.col("_three").isNotNull())
    return hit.select(*keys, F.col("line").alias("path"), *(F.regexp_extract("_two", pattern, k + 1).alias(n) for k, n in enumerate(("title", "artist", "link"))), F.col("_three").alias("license"))
