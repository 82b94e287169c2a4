"""The driver's tables bound to the data model, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwright.functions import arrays as A

SPLITS = ("train", "val", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: ids, tags, caption, vocals, speed, split, and unit audio and text vectors."""
    e, p, d = (table(spark, sf_dir, t) for t in ("embeddings", "part", "documents"))
    joined = e.join(p, e.vec_id == p.p_partkey).join(d.select("doc_id", "text", "lang"), F.col("doc_id") == e.vec_id)
    tags = F.array_distinct(F.filter(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))), lambda x: x != ""))
    return joined.select(
        F.col("vec_id").alias("clip_id"),
        F.floor(F.col("vec_id") / 2).alias("track_id"),
        F.col("p_brand").alias("artist_id"),
        F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod("label", F.lit(3)) + 1).cast("int")).alias("split"),
        F.sort_array(tags).alias("tags"),
        F.col("text").alias("caption"),
        F.when(F.col("lang").isin("en", "fr"), "vocal").when(F.col("lang") == "de", "instrumental").otherwise("").alias("vocals"),
        F.when(F.col("p_size") <= 15, "slow").when(F.col("p_size") <= 35, "medium").otherwise("fast").alias("speed"),
        A.unit(F.slice("embedding", 1, 32)).alias("audio"),
        A.unit(F.slice("embedding", 33, 32)).alias("text_vec"),
    )


def _unit_sql(part: str) -> str:
    return f"list_transform({part}, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform({part}, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"


CLIPS_SQL = f"""clips AS (
  SELECT vec_id AS clip_id, vec_id // 2 AS track_id, p_brand AS artist_id, ['train', 'val', 'test'][label % 3 + 1] AS split,
         list_sort(list_distinct(list_filter(list_append(string_split(p_name, ' '), lower(p_type)), lambda x: x <> ''))) AS tags,
         text AS caption, CASE WHEN lang IN ('en', 'fr') THEN 'vocal' WHEN lang = 'de' THEN 'instrumental' ELSE '' END AS vocals,
         CASE WHEN p_size <= 15 THEN 'slow' WHEN p_size <= 35 THEN 'medium' ELSE 'fast' END AS speed,
         {_unit_sql('embedding[1:32]')} AS audio, {_unit_sql('embedding[33:64]')} AS text_vec
  FROM embeddings JOIN part ON vec_id = p_partkey JOIN documents ON doc_id = vec_id)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction variants with two raters' scores: chain, turn, variant (0, 1, ...), score_a, score_b, hardness and split."""
    li = table(spark, sf_dir, "lineitem")
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(F.col(c).asc_nulls_last() for c in rest))
    a = 1 + F.rint("l_quantity").cast("int") % 5  # the SQL cast rounds half to even, and % keeps the sign
    b = F.greatest(F.lit(1), F.least(F.lit(5), a + F.pmod("l_partkey", F.lit(3)).cast("int") - 1))
    return li.select(
        F.col("l_orderkey").alias("chain_id"),
        F.col("l_linenumber").alias("turn"),
        (F.row_number().over(w) - 1).alias("variant"),
        a.cast("int").alias("score_a"),
        b.cast("int").alias("score_b"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int")).alias("hardness"),
        F.element_at(F.array(*map(F.lit, SPLITS)), (F.pmod("l_orderkey", F.lit(3)) + 1).cast("int")).alias("split"),
        F.col("l_partkey").alias("target_clip"),
        F.col("l_suppkey").alias("source_clip"),
    )


VARIANTS_SQL = """variants AS (
  SELECT l_orderkey AS chain_id, l_linenumber AS turn,
         CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS variant,
         CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS score_a,
         CAST(greatest(1, least(5, 1 + CAST(l_quantity AS INTEGER) % 5 + l_partkey % 3 - 1)) AS INTEGER) AS score_b,
         ['easy', 'medium', 'hard'][l_suppkey % 3 + 1] AS hardness, ['train', 'val', 'test'][l_orderkey % 3 + 1] AS split,
         l_partkey AS target_clip, l_suppkey AS source_clip
  FROM lineitem)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of texts: chain_id, turn and text, with the text of the turn before and of the first turn."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn"), "role", "text")
    w = Window.partitionBy("chain_id").orderBy("turn")
    return c.withColumn("previous", F.lag("text").over(w)).withColumn("seed", F.first("text").over(w))


TURNS_SQL = """turns AS (
  SELECT conv_id AS chain_id, turn, role, text, lag(text) OVER w AS previous, first_value(text) OVER w AS seed
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def turn_tags(c):
    """The distinct words of a text stand for the tags that conversations don't have."""
    from stepwright.functions.text import simple_tokens

    return F.sort_array(F.array_distinct(simple_tokens(c)))


def turn_tags_sql(c: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')))"
