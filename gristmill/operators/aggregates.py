"""Aggregations, all with partial aggregates before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def first_by(column: str, order: str) -> Column:
    """The column's first non-null value in the order: the same in every run."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def majority(votes: DataFrame, group: list[str], choice: str, none: str = "none") -> DataFrame:
    """(group, choice, n, votes): the choice of more than half of a group's votes, unless it is `none`."""
    n = votes.groupBy(*group, choice).agg(F.count("*").alias("n"))
    total = n.withColumn("votes", F.sum("n").over(Window.partitionBy(*group)))
    return total.where((F.col("n") * 2 > F.col("votes")) & (F.col(choice) != none))


def mode(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """The commonest value of each group, the smallest of several."""
    n = df.groupBy(*group, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def confusion(df: DataFrame, truth: Column, guess: Column, *group: str) -> DataFrame:
    """tp, fp, fn, tn, precision (1 without positive guesses) and recall (0 without positives)."""
    counts = df.groupBy(*group).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", F.round(F.when(tp + fp == 0, 1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0))), 6)).withColumn("recall", F.round(F.when(tp + fn == 0, 0.0).otherwise(tp / F.nullif(tp + fn, F.lit(0))), 6))


def single_gold(ranked: DataFrame, query: str, rank: str, k: int) -> DataFrame:
    """recall@k, MRR and nDCG over queries; rank: that of the one right answer, null if it wasn't found."""
    hit = F.col(rank).isNotNull() & (F.col(rank) <= k)
    return ranked.agg(
        F.count(query).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("recall"),
        F.round(F.avg(F.when(hit, 1.0 / F.col(rank)).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(F.when(hit, 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)), 6).alias("ndcg"))


def many_gold(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Per query recall = hits / relevant and the reciprocal rank of the first hit, within k."""
    hits = ranked.where(F.col(rank) <= k).join(relevant, [query, item]).groupBy(query).agg(F.count("*").alias("hits"), F.min(rank).alias("first"))
    sizes = relevant.groupBy(query).agg(F.count("*").alias("size"))
    return sizes.join(hits, query, "left").select(query, F.round(F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def agreement(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Numbers of unordered pairs in both, only the left and only the right."""
    canonical = lambda df, name: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().withColumn(name, F.lit(1))
    both = canonical(left, "l").join(canonical(right, "r"), ["a", "b"], "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


#: Rows of a group up to which they are ranked in one task, and the cut points of a round of selection.
FEW, CUTS = 50_000, 64


def _rank_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, _name, _v): of rows (_g, _name, _v), FEW a key at most, the one at place _i from 0."""
    place = F.row_number().over(Window.partitionBy("_g", "_name").orderBy("_v")) - 1
    return rows.withColumn("_p", place).join(wanted.select("_g", "_name", "_i"), ["_g", "_name"]).where("_p = _i").select("_g", "_name", "_v")


def nearest_rank(df: DataFrame, column: str, shares: dict[str, float], *group: str) -> DataFrame:
    """Percentiles as sorted[int(n * share)], without interpolation; exact, by selection. Nulls are left out.

    A group of more than FEW rows is never sorted. Cut points from a sketch part its values; counts of
    the parts, which are exact whatever the cut points, tell which part holds the rank; if it is a cut
    point itself, that is the value, and else the part's rows are parted again until they are few.
    """
    from gristmill.operators.graph import stored

    key = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("all"))
    values = df.where(F.col(column).isNotNull()).select(key.alias("_g"), F.col(column).alias("_v"))
    sizes = stored(values.groupBy("_g").agg(F.count("*").alias("_n")))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.floor(F.col("_n") * share).alias("_i")) for name, share in shares.items()])).alias("_w")
    wanted = stored(sizes.select("_g", "_n", names).select("_g", "_n", "_w.*").withColumns({"_low": F.lit(None).cast(values.schema["_v"].dataType), "_high": F.lit(None).cast(values.schema["_v"].dataType)}))
    answers: list[DataFrame] = []
    while True:
        inside = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high")))
        few = wanted.where(F.col("_n") <= FEW)
        answers.append(_rank_in(values.join(few, "_g").where(inside).select("_g", "_name", "_v"), few))
        many = wanted.where(F.col("_n") > FEW)
        if many.isEmpty():
            break
        rows = values.join(many, "_g").where(inside)
        cuts = rows.groupBy("_g", "_name").agg(F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], 1000)).alias("_cuts"))
        below = F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
        on = (below > 0) & (F.get("_cuts", below - 1) == F.col("_v"))
        parts = rows.join(stored(cuts), ["_g", "_name"]).groupBy("_g", "_name", "_i", "_low", "_high", "_cuts", F.when(on, 2 * below - 1).otherwise(2 * below).alias("_b")).agg(F.count("*").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g", "_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 2 CUTS + 3 parts at most
        own = stored(parts.withColumn("_before", before).where((F.col("_before") <= F.col("_i")) & (F.col("_i") < F.col("_before") + F.col("_c"))))
        half = F.floor(F.col("_b") / 2).cast("int")
        answers.append(own.where("_b % 2 = 1").select("_g", "_name", F.get("_cuts", half).alias("_v")))
        wanted = own.where("_b % 2 = 0").select("_g", F.col("_c").alias("_n"), "_name", (F.col("_i") - F.col("_before")).alias("_i"), F.coalesce(F.get("_cuts", half - 1), "_low").alias("_low"), F.coalesce(F.get("_cuts", half), "_high").alias("_high"))
        wanted = stored(wanted)
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    out = every.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares])
    return out.select(*[F.col("_g")[c].alias(c) for c in group], *shares)
