"""A corpus pipeline over documents: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stepwright.llm import decontam, guesscost, langid, packing, simhash
from stepwright.llm.common import remove, remove_written, shared_dir, tables_written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay.

    Null, empty and letterless texts go, as no language can be told; repeated rows stay or go alike, null and repeated
    ids count for nothing; texts are scored whole; an empty table stays empty; columns may have any name.
    """
    return langid.keep_accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, that of the smallest id.

    Rows with a null id or a text without a word stay; rows that repeat an id stay or go as their texts do, together if
    those are equal; texts are hashed whole; an empty table stays empty; columns may have any name.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; repeated rows stay or go alike, null and repeated ids count for nothing; texts are
    searched whole; an empty table stays empty, and without benchmark items all stay; columns may have any name.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values in credential context are replaced; the documents stay.

    All rows stay, with null, empty and repeated texts as they are; values of any length are replaced whole, and n_chars
    follows the text; an empty table stays empty; columns may have any name.
    """
    return guesscost.redacted(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in its bin.

    Null, empty and blank texts and null ids have no piece; long texts have several; repeated rows are pieces of their
    own; an empty table gives no rows; other columns are not looked at.
    """
    return packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing_plan)]

#: SQL has no fingerprints, forward algorithm or alignment: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    A stage's input and what it wrote on its way are removed when its result is written; the last stage's remain, as its
    result is read from them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        first = tables_written()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        remove_written(spark, first)
        if before:
            remove(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
