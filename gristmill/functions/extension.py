"""Extension points: functions of the caller that take part in a query, always in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def confidence(df: DataFrame, key: str, grade: str, weights: Mapping[str, float], fallback: float, combine: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Per key a confidence from its grades; how grades are combined is the caller's choice."""
    w = F.lit(fallback)
    for name, value in weights.items():
        w = F.when(F.col(grade) == name, value).otherwise(w)
    return df.groupBy(key).agg(F.round(combine(w), 6).alias("confidence"))


def grouped_confidence(f: Callable[[list], float], fallback: float = 0.3) -> Callable[[Column], Column]:
    """A grouped aggregate from a plain function of a list of grades."""
    @F.pandas_udf("double")
    def run(grades: pd.Series) -> float:
        values = [g for g in grades if g is not None]
        return float(f(values)) if values else fallback

    return run


def encoder(f: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column of vectors from a batch function of texts."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(f(texts.fillna("").tolist()))

    return run


def judged(df: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], name: str, kind: DataType | str = "string") -> DataFrame:
    """df with a verdict per row from a batch function: the border to a remote judge."""
    schema = df.withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches):
        for rows in batches:
            yield rows.assign(**{name: judge(rows)})

    return df.mapInPandas(run, schema)


def expanded(df: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A caller's DataFrame function: reranker, query expansion, neighbour callback."""
    return expand(df)
