"""Helpers shared by the operators: word rules, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the "plain word" rule, and everything but digits, a-z and non-ASCII of the "alphanumeric word" rule.
PLAIN_GAP = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows and bytes up to which a side may be broadcast after it has been measured.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 16 << 20
#: A key that holds more than one in HOT rows is hot; there are fewer than HOT such keys.
HOT = 256


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def plain_words(col: Column) -> Column:
    return F.array_remove(F.split(col, PLAIN_GAP), "")


def alnum_words(col: Column) -> Column:
    """col must be lower-cased already."""
    return F.array_remove(F.split(col, ALNUM_GAP), "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
        base = jsc.getCheckpointDir().get()
    return f"{base.rstrip('/')}/gristmill/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives a lost executor and is computed once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct _row, so that no name in it clashes with an operator's own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def _bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes up in memory."""
    fixed = {"string": F.octet_length, "binary": F.octet_length}
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        parts.append(F.coalesce(fixed[kind](col), F.lit(0)) + 16 if kind in fixed else F.lit(16) if kind not in ("array", "map", "struct") else F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16)
    return sum(parts[1:], parts[0])


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df, once measured, has no more than the given rows and BROADCAST_BYTES."""
    rows = BROADCAST_ROWS if rows is None else rows
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(_bytes(df).cast("long"))).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it fits, else df for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left join with a written table that is unique in `on`, whatever share of left one key holds; left is scanned several times.

    Hot keys, fewer than HOT, fetch their rows from a broadcast; all others are shuffled. Rows with a
    null in `on` find nothing.
    """
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    few = max(1, left.count() // HOT)
    hot = written(left.where(known).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*on))  # fewer than HOT rows
    more = [c for c in right.columns if c not in on]
    none = left.where(~known).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more])
    some = left.where(known)
    common = some.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, "left")
    other = some.join(F.broadcast(hot), on, "left_anti").join(right, on, "left")
    columns = [*left.columns, *more]
    return common.select(columns).unionByName(other.select(columns)).unionByName(none.select(columns))


def found(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """lookup by a broadcast of the whole right side where it fits."""
    return left.join(F.broadcast(right), on, "left") if fits(right) else lookup(left, right, on)


def salted(left: DataFrame, right: DataFrame, on: str, parts: int = 32) -> DataFrame:
    """Inner join of a left side that is scanned twice with a right side that is unique in `on` and too wide to broadcast.

    Rows of hot keys of the left, fewer than HOT, are dealt over `parts` copies of the key's right row.
    """
    few = max(1, left.count() // HOT)
    hot = F.broadcast(written(left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(on, F.lit(True).alias("_hot"))))
    is_hot = F.coalesce("_hot", F.lit(False))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int")).otherwise(0)).drop("_hot")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copies, [on, "_salt"]).drop("_salt")
