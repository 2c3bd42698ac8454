"""Window operators; every frame is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def mark_repeats(df: DataFrame, keys: list[str], order: list[Column], name: str, first: Column, other: str) -> DataFrame:
    """Names every row after the first of its keys `other`."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(r > 1, other).otherwise(first))


def fold_total(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """The first row of its keys, with the column's total over all of them."""
    return keep_first(df.withColumn(column, F.sum(column).over(Window.partitionBy(*keys))), keys, order)


def round_robin(df: DataFrame, bucket: str, order: list[Column], n: int) -> DataFrame:
    """n rows dealt over the buckets in turn: by rank in the bucket, then bucket."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return ranked.orderBy("_r", bucket).limit(n).drop("_r")


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, name: str = "n") -> DataFrame:
    """Number of the key's rows in the seconds up to and with this one."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return df.withColumn(name, F.count("*").over(w))


def weighted_recent(df: DataFrame, key: str, order: list[Column], value: str, weights: list[float], most: float, name: str = "score") -> DataFrame:
    """Per key the weighted mean of the latest values, the latest first, no more than `most`."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= len(weights))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_r") - 1).cast("int"))
    return r.groupBy(key).agg(F.round(F.least(F.sum(w * F.col(value)) / F.sum(w), F.lit(most)), 6).alias(name))


def prior(df: DataFrame, key: str, order: list[Column], flag: Column, name: str) -> DataFrame:
    """Sum of a flag over the key's earlier rows."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(flag.cast("bigint")).over(w), F.lit(0).cast("bigint")))


def delta(df: DataFrame, key: list[str], order: list[Column], column: str, name: str = "delta") -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column).over(Window.partitionBy(*key).orderBy(*order)))


def miss_rounds(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "miss_rounds") -> DataFrame:
    """Length of the run of zeros that ends at each row: reset by a value above 0, counted per keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_i", F.sum((F.col(value) > 0).cast("int")).over(w))
    run = Window.partitionBy(*keys, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum((F.col(value) <= 0).cast("bigint")).over(run)).drop("_i")
