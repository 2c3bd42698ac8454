"""What a reader's tools ask for, answered for all requests of a table at once; owners see nothing of each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fetched(requests: DataFrame, rows: DataFrame, key: str, owner: str, fields: Mapping[str, Column], gone: Column | None = None, error: str = "Not found") -> DataFrame:
    """(the requests' columns, fields, error): for each request (key, owner) its owner's row, or nulls and the error.

    Another owner's row, one for which `gone` holds, a null key or owner and a missing row are all the same error. Keys are unique
    in rows, requests may repeat. The fields' names must not be those of the requests.
    """
    there = rows if gone is None else rows.where(~F.coalesce(gone, F.lit(False)))
    there = there.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), *[c.alias(n) for n, c in fields.items()], F.lit(True).alias("_there"))
    found = requests.join(there, (F.col(key) == F.col("_key")) & (F.col(owner) == F.col("_owner")), "left")
    return found.withColumn("error", F.when(F.col("_there").isNull(), error)).drop("_key", "_owner", "_there")


def recent(rows: DataFrame, owner: str, order: list[Column], limit: int, gone: Column | None = None) -> DataFrame:
    """(rows, at): each owner's first rows in this order; ranks are cut before the shuffle, so a large owner stays a small group."""
    there = (rows if gone is None else rows.where(~F.coalesce(gone, F.lit(False)))).where(F.col(owner).isNotNull())
    return there.withColumn("at", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("at") <= limit)


def changes_since(changes: DataFrame, cursors: DataFrame, owner: str, seq: str, limit: int) -> DataFrame:
    """(changes, at): each owner's next changes after their cursor (owner, since), in order; without a cursor from the first."""
    known = cursors.groupBy(owner).agg(F.max("since").alias("_since"))
    due = changes.join(known, owner, "left").where(F.col(seq) > F.coalesce("_since", F.lit(0))).drop("_since")
    return recent(due, owner, [F.col(seq)], limit)
