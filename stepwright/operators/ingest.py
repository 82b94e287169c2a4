"""Ingest rules: drop reasons, split assignment, vocabularies, lyric states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.labels import hallucination
from stepwright.functions.text import strip
from stepwright.operators.keys import sum_before


def drop_reason(caption: Column, tags: Column, audio_exists: Column, missing_caption: bool = True, missing_tags: bool = False, missing_audio: bool = False) -> Column:
    """missing_caption, missing_tags or audio_not_found, in this order, or null for a row that stays."""
    return F.coalesce(
        F.when(F.lit(missing_caption) & (strip(caption) == ""), "missing_caption"),
        F.when(F.lit(missing_tags) & (F.coalesce(F.size(tags), F.lit(0)) == 0), "missing_tags"),
        F.when(F.lit(missing_audio) & ~F.coalesce(audio_exists, F.lit(False)), "audio_not_found"),
    )


def canonical_split(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("val", "valid", "validation", "dev"), "validation").otherwise(low)


def group_split(df: DataFrame, group: str, seed: int = 13, train: float = 0.90, val: float = 0.05) -> DataFrame:
    """df with split: whole groups, in the order of a seeded hash, fill train, then val; the rest is test.

    A group goes to train while fewer than floor(n * train) rows are before it, then to val while fewer than
    floor(n * val) rows of val are. Blank groups count as one, __unknown__.
    """
    g = F.coalesce(F.nullif(strip(F.col(group)), F.lit("")), F.lit("__unknown__"))
    sizes = df.groupBy(g.alias("_g")).agg(F.count("*").alias("_n")).withColumn("_h", F.sha1(F.concat_ws(":", F.lit(str(seed)), "_g")))
    s = sum_before(sizes, ["_h", "_g"], "_n", "_pre")
    s = s.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_total")))).withColumn("_train", F.col("_pre") < F.floor(F.col("_total") * train))
    s = s.crossJoin(F.broadcast(s.agg(F.coalesce(F.sum(F.when(F.col("_train"), F.col("_n"))), F.lit(0)).alias("_trained"))))
    s = s.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_pre") - F.col("_trained") < F.floor(F.col("_total") * val), "val").otherwise("test"))
    return df.withColumn("_g", g).join(s.select("_g", "split"), "_g").drop("_g")


def vocabulary(df: DataFrame, tags: str, n: int | None) -> DataFrame:
    """tag and n of the most frequent tags (ties by tag): all of them if n is None, none if n <= 0."""
    counts = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    if n is None:
        return counts
    return counts.orderBy(F.col("n").desc(), "tag").limit(max(0, n))


def keep_vocabulary(df: DataFrame, tags: str, vocab: DataFrame) -> DataFrame:
    """df with only the tags of a top-n vocabulary, in their order; the vocabulary is one row of n tags."""
    one = vocab.agg(F.collect_set("tag").alias("_vocab"))
    return df.crossJoin(F.broadcast(one)).withColumn(tags, F.filter(tags, lambda t: F.array_contains("_vocab", t))).drop("_vocab")


def lyric_state(vocals: Column, transcript: Column, failed: Column, allowed: tuple[str, ...] = ("vocal",)) -> Column:
    """struct(status, lyrics, error): non_vocal, failed, filtered, empty or ok."""
    v, t = F.lower(strip(vocals)), strip(transcript)
    why = hallucination(t)
    state = (
        F.when(~v.isin(*allowed), F.struct(F.lit("non_vocal").alias("status"), F.lit("").alias("lyrics"), F.lit("").alias("error")))
        .when(failed, F.struct(F.lit("failed").alias("status"), F.lit("").alias("lyrics"), F.lit("transcription_failed").alias("error")))
        .when(why.isNotNull(), F.struct(F.lit("filtered").alias("status"), F.lit("").alias("lyrics"), why.alias("error")))
        .when(t == "", F.struct(F.lit("empty").alias("status"), F.lit("").alias("lyrics"), F.lit("").alias("error")))
    )
    return state.otherwise(F.struct(F.lit("ok").alias("status"), t.alias("lyrics"), F.lit("").alias("error")))


def reusable(status: Column, vocals: Column, lyrics: Column, allowed: tuple[str, ...] = ("vocal",)) -> Column:
    """Whether a previous result is still right: ok or empty, and passing the present filters."""
    return status.isin("ok", "empty") & F.lower(strip(vocals)).isin(*allowed) & hallucination(lyrics).isNull()


def tag_groups(genres: Column, instruments: Column, others: Column) -> Column:
    """The nested record of a source's tags, missing groups being empty."""
    none = F.array().cast("array<string>")
    return F.struct(*(F.coalesce(c, none).alias(n) for n, c in (("genres", genres), ("instruments", instruments), ("vartags", others))))


def mapped(df: DataFrame, fields: dict[str, str], tags: Column, more: list[str] | None = None) -> DataFrame:
    """Canonical columns from a source's field names: text fields stripped, null as empty; tags are the groups of tag_groups() in one list.

    A field that df lacks is empty, so that sources need not have all of them.
    """
    known = set(df.columns)
    texts = [(strip(F.col(f"`{source}`")) if source in known else F.lit("")).alias(name) for name, source in fields.items()]
    whole = F.filter(F.concat(tags["genres"], tags["instruments"], tags["vartags"]), lambda t: strip(t) != "")
    return df.select(*(more or []), *texts, F.array_distinct(F.transform(whole, strip)).alias("tags"))


def snapshot(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that are not empty, in the given order."""
    return F.to_json(F.struct(*(F.nullif(strip(c), F.lit("")).alias(n) for n, c in fields.items())))


def text_changes(source: Column, target: Column) -> dict[str, Column]:
    """Aggregates over pairs of texts: with a source, with a target, both, changed, added, removed."""
    s, t = strip(source) != "", strip(target) != ""
    return {"with_source": F.count_if(s), "with_target": F.count_if(t), "with_both": F.count_if(s & t), "changed": F.count_if(s & t & (strip(source) != strip(target))), "added": F.count_if(~s & t), "removed": F.count_if(s & ~t)}
