"""Tables as values: reads, and writes expressed as rewrites, since a DataFrame is never changed."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_one(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def select(spark: SparkSession, sql: str, arguments: Mapping[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """A query with named arguments; nothing is cut unless a limit is given."""
    out = spark.sql(sql, args=dict(arguments or {}))
    return out if limit is None else out.limit(limit)


def insert(df: DataFrame, path: str) -> DataFrame:
    """Appends and returns the rows."""
    df.write.mode("append").parquet(path)
    return df


def insert_returning(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Appends df as a batch of its own and returns columns of the rows as they were stored."""
    batch = f"{path.rstrip('/')}/batch={uuid.uuid4().hex}"
    df.write.parquet(batch)
    return df.sparkSession.read.schema(df.schema).parquet(batch).select(*columns)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base plus those new rows whose keys it doesn't have; of new rows with equal keys one."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new in place of those with equal keys."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def upsert_sum(base: DataFrame, new: DataFrame, keys: list[str], sums: list[str], latest: list[str], order: str) -> DataFrame:
    """Sums over old and new rows of equal keys; other columns from the latest row."""
    return base.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, order).alias(c) for c in latest])


def update(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def soft_delete(df: DataFrame, where: Column, now: Column) -> DataFrame:
    """Sets deleted_at where the condition holds and it isn't set."""
    return df.withColumn("deleted_at", F.coalesce("deleted_at", F.when(where, now)))


def validated(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(columns of df, rule): a row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.withColumn("rule", F.explode(broken))
