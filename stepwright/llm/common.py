"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; batches are cut to this size, rows are never cut.
SLICE_BYTES = 3_000_000
#: A join side is broadcast only when its counted rows are no more than this.
BROADCAST_ROWS = 4_000_000


#: Tables that written() has made and nothing has removed.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one where that is unset on a local master (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stepwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the written table: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables written() has made and nothing has removed."""
    return len(_WRITTEN)


def remove_written(spark: SparkSession, first: int, last: int | None = None) -> None:
    """Delete the tables that written() made from the first to before the last: for use when what was made of them is written itself."""
    paths = _WRITTEN[first:last]
    del _WRITTEN[first:last]
    for at in paths:
        remove(spark, at)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that are like those given and no column of df has, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def sized(side: DataFrame, rows: int) -> DataFrame:
    """side with a broadcast hint if its counted rows are few enough, else unchanged: a shuffle join."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def once(key: tuple, make: Callable):
    """make(), called once in a process. Functions shipped by value have globals of their own, so the results lie beside the interpreter's modules."""
    kept = sys.modules.setdefault("_stepwright_once", types.ModuleType("_stepwright_once")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text each; a longer row is a run of its own."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    ends = np.cumsum(size)
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and would keep each stage's most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, make: Callable, schema, column: str, most: int = SLICE_BYTES) -> DataFrame:
    """df.mapInArrow of make()(slice) for each slice; make runs once in each task and returns the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield from kernel(part)
            give_back()
        del kernel
        give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (one more than rows) of a string array; nulls have no bytes."""
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of hashes (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_strings(column: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each string's bytes, by numpy over all strings at once."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64)
    # The power of each byte follows its distance from its string's start, so equal strings hash alike.
    length = np.diff(offsets)
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(offsets[:-1], length)
    most = int(length.max(initial=0))
    power = np.cumprod(np.full(most + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = (raw.astype(np.uint64) + np.uint64(1)) * power[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix64(total[offsets[1:]] - total[offsets[:-1]] + length.astype(np.uint64))

