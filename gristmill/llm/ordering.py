"""Running sums over a global order without a single-task window.

Rows carry the number of the range that they fall in; ranges follow the global order and are small
enough for one task. A running sum inside each range plus the sum of all earlier ranges, which come
from a table with one row per range, is the global running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import small


def running(df: DataFrame, within: list[str], ranges: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each out -> column in sums, the column's sum over all rows before this one in its `within` group.

    `ranges` number the group's ranges in order, `order` sorts the rows of a range.
    """
    keys = within + ranges
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*within).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0).cast("long")).alias(f"_s_{out}") for out in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0).cast("long")).alias(f"_r_{out}") for out, c in sums.items()])
    df = df.join(small(starts, 200_000), keys)
    for out in sums:
        df = df.withColumn(out, F.col(f"_s_{out}") + F.col(f"_r_{out}"))
    return df.drop(*[f"_{p}_{out}" for out in sums for p in "sr"])
