"""Operator 2. Best-fit packing planned on a length histogram.

Texts are cut into pieces of at most CONTEXT tokens (all but a text's last
piece are full). The pieces' lengths are counted; best-fit decreasing runs on
the counts, on the driver, over at most CONTEXT lengths; its plan says, for
each length, which slot of which bin its first, second, ... piece takes. The
pieces are ranked within their length and take their slots by a join on length
and rank. The plan equals best-fit decreasing over the single pieces.

Ranks are in the order of (bucket, id, piece), bucket being a hash of the id,
so that a length with very many pieces is ranked in many parts at once; there
are a bucket for each BUCKET_ROWS pieces, and LEAST_BUCKETS at least.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import sized, written

CONTEXT = 2048
LEAST_BUCKETS = 256
BUCKET_ROWS = 2_000_000
#: Ranks of one plan row: longer runs are cut, so that joins on the rank's block stay narrow.
BLOCK = 65_536


def tokens(text_col: str = "text"):
    """White-space tokens of a text, plus one for its end; null and blank texts have none."""
    n = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"\S+")), F.lit(0))
    return F.when(n == 0, 0).otherwise(n + 1)


def plan(histogram: dict[int, int], context: int = CONTEXT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (runs, bins).

    A run (length, rank, bins, each, bin, offset) gives the ranks from `rank` on to `bins` bins from `bin` on,
    `each` slots in each of them, the first at `offset`.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    # Open bins by free space: lists of (first bin, bins), and a heap-free search over at most `context` sizes.
    free: dict[int, list[tuple[int, int]]] = {}
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length <= 0 or left <= 0:
            continue
        for room in sorted(k for k in free if k >= length):
            if not left:
                break
            each = room // length
            while left and free.get(room):
                start, n = heapq.heappop(free[room])
                take = min(n, left // each)
                if take:
                    runs.append((length, rank, take, each, start, context - room))
                    rank, left = rank + take * each, left - take * each
                    if room - each * length:
                        heapq.heappush(free.setdefault(room - each * length, []), (start, take))
                    start, n = start + take, n - take
                elif left:
                    runs.append((length, rank, 1, left, start, context - room))
                    if room - left * length:
                        heapq.heappush(free.setdefault(room - left * length, []), (start, 1))
                    rank, left = rank + left, 0
                    start, n = start + 1, n - 1
                if n:
                    heapq.heappush(free[room], (start, n))
        if left:
            each = context // length
            take = left // each
            if take:
                runs.append((length, rank, take, each, bins, 0))
                if context - each * length:
                    heapq.heappush(free.setdefault(context - each * length, []), (bins, take))
                bins, rank, left = bins + take, rank + take * each, left - take * each
            if left:
                runs.append((length, rank, 1, left, bins, 0))
                if context - left * length:
                    heapq.heappush(free.setdefault(context - left * length, []), (bins, 1))
                bins += 1
        free = {k: v for k, v in free.items() if v}
    return runs, bins


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """doc_id, piece, start, length: full pieces of `context` tokens and the rest of each text with tokens and an id."""
    n = F.col("n")
    counted = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).cast("long").alias("n")).where("n > 0 and doc_id is not null")
    at = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / context).cast("long"))).alias("piece"))
    return at.select("doc_id", "piece", (F.col("piece") * context).alias("start"), F.least(F.lit(context).cast("long"), n - F.col("piece") * context).cast("int").alias("length"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """doc_id, piece, start, length, bin, offset: the place of each piece of each text.

    Null, empty and blank texts and null ids have no piece; longer texts have several. Repeated ids and rows are
    pieces of their own (their order among themselves does not show). Bins are numbered from 0 without gaps, and an
    empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, context), "pieces")
    buckets = max(LEAST_BUCKETS, cut.count() // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counts = written(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(histogram, context)
    rows = []
    for length, rank, n, each, first, offset in runs:
        end = rank + n * each
        for block in range(rank // BLOCK, (end - 1) // BLOCK + 1):
            rows.append((length, block, rank, end, each, first, offset))
    slots = spark.createDataFrame(rows, "length int, block long, rank_from long, rank_to long, each int, bin_from long, offset_from int")
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = cut.withColumn("r", F.row_number().over(within) - 1).join(sized(base, len(histogram) * buckets), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = ranked.join(sized(slots, len(rows)), ["length", "block"]).where("rank >= rank_from and rank < rank_to")
    into = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length",
        (F.col("bin_from") + F.floor(into / F.col("each"))).cast("long").alias("bin"),
        (F.col("offset_from") + F.pmod(into, F.col("each")) * F.col("length")).cast("int").alias("offset"),
    )
