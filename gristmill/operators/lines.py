"""Operators on the lines of texts; each scans narrowly and shuffles only counts or kept lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))


def without_repeated(df: DataFrame, key: str, text: str, least: int, low: int = 5, high: int = 250) -> DataFrame:
    """(key, text, dropped): texts without lines of low to high characters that stand `least` times or more in their document.

    A document's lines are an array of its row: no line leaves its task. Equal lines are neighbours once they are
    sorted, so that a text of many lines takes no square of them.
    """
    lines = F.split(text, "\n")
    same = lambda x, i: F.get(F.col("_s"), i) == x
    often = F.filter("_s", lambda x, i: same(x, i + (least - 1)) & ~F.coalesce(same(x, i - 1), F.lit(False)))
    rows = df.select(key, lines.alias("_l")).withColumn("_s", F.array_sort(F.filter("_l", lambda x: F.length(x).between(low, high))))
    rows = rows.withColumn("_often", F.when(F.size("_s") >= least, often).otherwise(F.array().cast("array<string>")))
    kept = F.filter("_l", lambda x: ~F.array_contains("_often", x))
    return rows.select(key, F.array_join(kept, "\n").alias(text), (F.size("_l") - F.size(kept)).cast("bigint").alias("dropped"))


def without_noise(df: DataFrame, key: str, text: str, reason) -> DataFrame:
    """(key, text, dropped): texts without lines that `reason` names."""
    kept = F.filter("_l", lambda x: reason(x).isNull())
    return df.select(key, F.split(text, "\n").alias("_l")).select(key, F.array_join(kept, "\n").alias(text), (F.size("_l") - F.size(kept)).cast("bigint").alias("dropped"))


def window_density(df: DataFrame, key: str, text: str, width: int, pattern: str) -> DataFrame:
    """(key, at, n): matches of the pattern in each window of `width` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    at = df.select(key, text, F.explode(starts).alias("at"))
    return at.select(key, "at", F.regexp_count(F.substring(F.col(text), F.col("at") + 1, F.lit(width)), F.lit(pattern)).cast("bigint").alias("n"))


def keyword_class(df: DataFrame, key: str, title: Column, body: Column, keywords: dict[str, list[str]], title_weight: int = 5, least: int = 3, ratio: float = 1.6) -> DataFrame:
    """(key, label, score): the class whose keywords score highest, null below `least` or within `ratio` of the second."""
    def score(words: list[str]) -> Column:
        hit = lambda c, w: F.when(F.lower(c).contains(w), 1).otherwise(0)
        return sum((hit(title, w) * title_weight + hit(body, w) for w in words), F.lit(0))

    best = F.array_sort(F.array(*[F.struct((-score(words)).alias("s"), F.lit(name).alias("label")) for name, words in sorted(keywords.items())]))
    rows = df.select(key, best.alias("b"))
    top, second = -F.col("b")[0]["s"], -F.col("b")[1]["s"]
    sure = (top >= least) & (top >= second * ratio)
    return rows.select(key, F.when(sure, F.col("b")[0]["label"]).alias("label"), top.cast("bigint").alias("score"))
