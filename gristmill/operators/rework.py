"""Rewrites of knowledge already held: sources read anew, and the list of what is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reingested(units: DataFrame, ingested: DataFrame, again: DataFrame, reason: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The units, their new history rows and the ingested sources after some sources were opened to be read again.

    units: (unit_id, source, grade, valid_until, superseded_by, ...); those of a source in `again` (source) that are current
    (valid_until is null) end now, without a successor, since the new reading may cut otherwise. history:
    (unit_id, from_grade, to_grade, trigger), a row for each of them with its grade unchanged. ingested: (source, ...) loses
    the sources, so that the next tick reads them. A source that stands in `again` twice, or has no units, does no harm;
    null sources are never opened. Nothing is deleted from units.
    """
    opened = again.select("source").where("source is not null").distinct().withColumn("_again", F.lit(True))
    marked = units.join(opened, "source", "left")
    due = F.col("_again").isNotNull() & F.col("valid_until").isNull()
    after = marked.withColumn("valid_until", F.when(due, now).otherwise(F.col("valid_until"))).select(*units.columns)
    history = marked.where(due).select("unit_id", F.col("grade").alias("from_grade"), F.col("grade").alias("to_grade"), F.lit(f"reingest: {reason}").alias("trigger"))
    return after, history, ingested.join(opened.select("source"), "source", "left_anti").select(*ingested.columns)


def overlap(topic: Column, purpose: str) -> Column:
    """The share of a topic's distinct words that stand in the purpose; 0 for a topic without words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(topic, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    wanted = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(purpose)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.round(F.size(F.array_intersect(words, wanted)) / F.greatest(F.size(words), F.lit(1)), 4)


def merged_needs(old: DataFrame, proactive: DataFrame | None, missed: DataFrame, purpose: str = "") -> DataFrame:
    """(part, at, topic, reason, miss_count, purpose_score), in the order in which needs are served.

    Needs that follow from directions come first (part 0, by at): `proactive` (at, topic) if it was computed in this
    tick, even if it is empty, and those of old if it is None. Then (part 1) the missed topics (topic,
    miss_count), by their overlap with the purpose, then by misses and topic; without a purpose all scores are null.
    Old missed topics go, as missed holds the present ones. old: an earlier result, of which at and topic count.
    """
    first = (old.where("part = 0") if proactive is None else proactive).select(F.lit(0).alias("part"), F.col("at").cast("bigint").alias("at"), "topic", F.lit("direction").alias("reason"))
    first = first.withColumn("miss_count", F.lit(None).cast("bigint")).withColumn("purpose_score", F.lit(None).cast("double"))
    score = overlap(F.col("topic"), purpose) if purpose else F.lit(None)
    second = missed.select(
        F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("at"), "topic", F.lit("high_miss").alias("reason"),
        F.coalesce("miss_count", F.lit(0)).cast("bigint").alias("miss_count"), score.cast("double").alias("purpose_score"))
    return first.unionByName(second).orderBy("part", "at", F.col("purpose_score").desc_nulls_last(), F.col("miss_count").desc(), "topic")
