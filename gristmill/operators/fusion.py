"""Retrieval: dense and lexical channels, their fusion, and reranking by verdicts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.topk import ranked


def lexical(df: DataFrame, key: str, text: str, terms: list[str], k: int, name: str = "l_rank") -> DataFrame:
    """(key, score, rank): documents by TF-IDF of the query terms; Han text counts as pairs of characters, in terms as well.

    Texts are cut into words once and only the terms' places are grouped. Keys are unique.
    """
    wanted = list(dict.fromkeys(w for t in terms for w in ([t[i : i + 2] for i in range(len(t) - 1)] if re.fullmatch("[一-鿿]{2,}", t) else [t])))
    words = F.concat(F.split(F.lower(text), "[^a-z0-9]+"), F.regexp_extract_all(F.col(text), F.lit("(?=([一-鿿]{2}))"), F.lit(1)))
    tf = df.select(key, F.explode(words).alias("_w")).where(F.col("_w").isin(wanted)).groupBy(key, "_w").agg(F.count("*").alias("_t"))
    have = F.broadcast(tf.groupBy("_w").agg(F.count("*").alias("_d")))  # one row for each term
    n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    score = F.sum((1 + F.log(F.col("_t").cast("double"))) * F.log(1 + F.col("_n") / F.col("_d")))
    hits = tf.join(have, "_w").join(n).groupBy(key).agg(F.round(score, 6).alias("score")).where("score > 0")
    return ranked(hits, [F.col("score").desc(), F.col(key)], k, name)


def backfill(dense: DataFrame, lex: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pos): all dense hits by rank, then the lexical ones that dense has not."""
    both = dense.select(key, "d_rank").join(lex.select(key, "l_rank"), key, "full_outer")
    return both.withColumn("pos", F.coalesce("d_rank", F.lit(100_000) + F.col("l_rank"))).orderBy("pos").limit(k)


def rrf(lists: list[DataFrame], key: str, rank: str, k: int = 60, pinned: DataFrame | None = None, boost: float = 1.5) -> DataFrame:
    """(key, score): reciprocal rank fusion, ranks from 0; pinned keys' scores are multiplied."""
    out = lists[0].select(key, rank)
    for one in lists[1:]:
        out = out.unionByName(one.select(key, rank))
    fused = out.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col(rank) + 1)).alias("score"))
    if pinned is not None:
        fused = fused.join(pinned.select(key, F.lit(boost).alias("_b")).distinct(), key, "left").withColumn("score", F.col("score") * F.coalesce("_b", F.lit(1.0))).drop("_b")
    return fused.withColumn("score", F.round("score", 6))


def reranked(hits: DataFrame, verdicts: DataFrame, position: str = "position") -> DataFrame:
    """hits in judged order, then the unjudged in their own; verdicts: (position, judged), the first of several counts."""
    first = verdicts.withColumn("_r", F.row_number().over(Window.partitionBy(position).orderBy("judged"))).where("_r = 1").drop("_r")
    return hits.join(first, position, "left").orderBy(F.col("judged").isNull(), "judged", position)


def rescored(hits: DataFrame, scores: list[float], n: int) -> DataFrame:
    """hits by the scores of a judge, or unchanged if it didn't give one for each."""
    if len(scores) != n:
        return hits.orderBy("position")
    s = F.get(F.array(*[F.lit(float(x)) for x in scores]), F.col("position").cast("int"))
    return hits.withColumn("judged", s).orderBy(F.col("judged").desc(), "position")
