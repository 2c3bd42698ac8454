"""A scheduler that keeps its books between ticks: who was served when, in a table that each tick appends to.

A tick has a queue of topics in buckets. Each bucket has a share of the day that is its own; what is
left of the day then goes to the rest of all queues. Who was never served comes first, then who waited
longest. No more than a month's cap is ever served, and reaching it ends the tick. A tick's rows are
in a folder of its own number, so that a tick that is run again replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERVED = "topic string, bucket string, day date, slot string, place bigint, tick bigint"


@dataclass(frozen=True)
class Quota:
    """Buckets in the order in which they are served, each one's own rows a day, and all rows of a day and a month."""

    buckets: tuple[str, ...]
    own: int
    day: int
    month: int


def served(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The ledger, or what it held before a tick."""
    try:
        rows = spark.read.schema(SERVED).parquet(folder)
        rows.limit(0).count()
    except Exception as missing:  # nothing was served yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], SERVED)
    return rows if before is None else rows.where(F.col("tick") < before)


def choose(queue: DataFrame, ledger: DataFrame, day: object, quota: Quota) -> DataFrame:
    """(topic, bucket, slot, place) of a tick: `own` rows of the buckets, then `overflow`. queue: topic, bucket, pos; a topic once."""
    today = F.lit(day).cast("date")
    month = ledger.where(F.date_trunc("month", "day") == F.date_trunc("month", today))
    counts = {r.bucket: (r.month, r.day) for r in month.groupBy("bucket").agg(F.count("*").alias("month"), F.count_if(F.col("day") == today).alias("day")).collect()}  # a row for each bucket
    left_month, left_day = quota.month - sum(m for m, _ in counts.values()), quota.day - sum(n for _, n in counts.values())
    last = ledger.groupBy("topic").agg(F.max("tick").alias("last"))
    order = F.coalesce(*[F.when(F.col("bucket") == b, i) for i, b in enumerate(quota.buckets)])
    waiting = queue.join(last, "topic", "left").withColumn("_b", order).where(F.col("_b").isNotNull())
    turn = [F.col("last").asc_nulls_first(), F.col("pos")]
    room = F.coalesce(*[F.when(F.col("_b") == i, max(0, quota.own - counts.get(b, (0, 0))[1])) for i, b in enumerate(quota.buckets)])
    first = waiting.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*turn))).where(F.col("_r") <= quota.own).where(F.col("_r") <= room)
    own = first.orderBy("_b", "_r").limit(max(0, left_month)).withColumn("slot", F.lit("own"))
    n = own.count()  # own times the buckets at most
    more = max(0, min(left_month - n, left_day - n))
    rest = waiting.join(own.select("topic"), "topic", "left_anti").orderBy(F.col("last").asc_nulls_first(), "_b", "pos").limit(more).withColumn("slot", F.lit("overflow"))
    both = own.select("topic", "bucket", "slot", "_b", "last", "pos").unionByName(rest.select("topic", "bucket", "slot", "_b", "last", "pos"))
    by = Window.orderBy(F.col("slot").desc(), F.when(F.col("slot") == "own", F.col("_b")).otherwise(0), F.col("last").asc_nulls_first(), "_b", "pos")  # a day's rows at most
    return both.withColumn("place", F.row_number().over(by).cast("bigint")).select("topic", "bucket", "slot", "place")


def tick(queue: DataFrame, number: int, folder: str, quota: Quota) -> None:
    """One tick, as foreachBatch calls it: queue has topic, bucket, pos and day; its last day is today."""
    spark = queue.sparkSession
    day = queue.agg(F.max("day")).first()[0]
    if day is None:
        return
    own = queue.groupBy("topic").agg(F.min(F.struct("pos", "bucket")).alias("_x")).select("topic", "_x.bucket", "_x.pos")
    rows = choose(own, served(spark, folder, number), day, quota).select("topic", "bucket", F.lit(day).cast("date").alias("day"), "slot", "place")
    rows.write.mode("overwrite").parquet(f"{folder}/tick={number}")


def run(queues: Sequence[DataFrame], quota: Quota) -> DataFrame:
    """The ledger after all queues have arrived in a folder, one after the other, each with a restart of the stream."""
    from gristmill.sources.files import shared_folder

    spark = queues[0].sparkSession
    folder = shared_folder(spark)
    for queue in queues:
        queue.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(queue.schema).parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(lambda df, n: tick(df, n, f"{folder}/served", quota)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return served(spark, f"{folder}/served")
