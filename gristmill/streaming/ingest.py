"""The ingest path of units into a knowledge base, as a stream with several sinks that agree.

A batch is split by rules: structural noise and units of an unknown type are rejected, the latter with a
lesson row; of units with one fingerprint the first that ever came stays, later ones are counted as
merges; an accepted unit gets an audit row of its grade; its tags are upserted, and a tag keeps its
first discipline that isn't null. Each sink has a folder a batch, which a batch that is run again
replaces, and reads only what earlier batches wrote: a replay changes nothing. State is what the
sinks hold, read back as views; no table is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.strings import fingerprint32
from gristmill.operators.gates import first_rule
from gristmill.operators.graph import stored

SINKS = {
    "units": "unit_id bigint, fp string, kind string, tag string",
    "merges": "fp string, unit_id bigint",
    "lessons": "lesson string, ref string, unit_id bigint",
    "audit": "unit_id bigint, old_grade string, new_grade string, reason string",
    "tags": "tag string, discipline string, unit_id bigint",
    "rejects": "unit_id bigint, reason string",
}


@dataclass(frozen=True)
class Rules:
    """noise: whether a unit is no knowledge; kinds: the vocabulary of types; grade: what an accepted unit starts with."""

    noise: Callable[[Column], Column]
    kinds: tuple[str, ...]
    grade: str = "unverified"


def sink(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    """A sink's rows with their batch, all or those before a batch; empty if it has none yet."""
    schema = f"{SINKS[name]}, batch bigint"
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
        rows.limit(0).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("batch") < before)


def persist(units: DataFrame, batch: int, folder: str, rules: Rules) -> None:
    """One batch of units: unit_id, text, kind, tag, discipline; ids are unique."""
    spark = units.sparkSession
    reason = first_rule([("noise", rules.noise(F.coalesce("text", F.lit("")))), ("vocabulary", ~F.coalesce(F.col("kind").isin(*rules.kinds), F.lit(False)))], "accepted")
    rows = stored(units.select("unit_id", "kind", "tag", "discipline", fingerprint32(F.coalesce("text", F.lit(""))).alias("fp"), reason.alias("reason")))
    good = rows.where("reason = 'accepted'")
    known = sink(spark, folder, "units", batch).select("fp", F.lit(True).alias("_known"))
    first = F.min("unit_id").over(Window.partitionBy("fp")) == F.col("unit_id")
    new = good.withColumn("_first", first).join(known, "fp", "left")  # fp is unique in the sink
    fresh = stored(new.withColumn("_new", F.col("_first") & F.col("_known").isNull()))
    own = fresh.where("_new")
    out = {
        "units": own, "merges": fresh.where("not _new"),
        "lessons": rows.where("reason = 'vocabulary'").select(F.lit("vocabulary").alias("lesson"), F.coalesce("kind", F.lit("")).alias("ref"), "unit_id"),
        "audit": own.select("unit_id", F.lit(None).cast("string").alias("old_grade"), F.lit(rules.grade).alias("new_grade"), F.lit("ingest").alias("reason")),
        "tags": own.where("tag is not null"), "rejects": rows.where("reason <> 'accepted'"),
    }
    for name, df in out.items():
        columns = [c.split()[0] for c in SINKS[name].split(", ")]
        df.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, discipline, units): a tag's first discipline that isn't null, and its accepted units."""
    order = F.struct("batch", "unit_id")
    return sink(spark, folder, "tags").groupBy("tag").agg(F.min_by("discipline", F.when(F.col("discipline").isNotNull(), order)).alias("discipline"), F.count("*").alias("units"))


def lessons(spark: SparkSession, folder: str) -> DataFrame:
    """(lesson, ref, occurrences, evidence): the first unit of each."""
    return sink(spark, folder, "lessons").groupBy("lesson", "ref").agg(F.count("*").alias("occurrences"), F.min_by("unit_id", F.struct("batch", "unit_id")).alias("evidence"))


def run(parts: Sequence[DataFrame], rules: Rules) -> str:
    """The folder of the sinks after all parts have arrived, one after the other, each with a restart of the stream."""
    from gristmill.sources.files import shared_folder

    spark = parts[0].sparkSession
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(lambda df, n: persist(df, n, folder, rules)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder
