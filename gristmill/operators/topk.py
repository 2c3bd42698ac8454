"""Sorting, paging and top-k. A limit always comes before a global rank, so that no window sees more than k rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import vectors as V


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_by(df: DataFrame, allowed: Mapping[str, Column], name: str, descending: bool, key: str) -> DataFrame:
    """Sorted by a column that the caller names, from a list of allowed ones; ties by key."""
    column = allowed[name]
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(key))


def ranked(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows with their rank from 1."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, dist): the k rows with the least cosine distance to the query; null vectors are left out."""
    scored = df.where(F.col(vector).isNotNull()).select(key, *keep, F.round(1 - V.cosine(V.as_double(F.col(vector)), V.literal(query)), 6).alias("dist"))
    return scored.orderBy("dist", key).limit(k)


def per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def capped(df: DataFrame, order: list[Column], k: int) -> tuple[DataFrame, int]:
    """The first k rows and the number of rows that were left out."""
    return df.orderBy(*order).limit(k), max(0, df.count() - k)


#: Edges of a proposing end that are looked at together.
LOOK = 16


def degree_capped(edges: DataFrame, group: str, src: str, dst: str, strength: str, k: int) -> DataFrame:
    """Per group, edges by falling strength (then src, then dst), each taken if both its ends have fewer than k taken edges.

    Where no src of a group is a dst there, the fewer ends propose and the others choose, which takes few rounds and small
    ones (`_proposed`); else edges are taken in rounds over all open ones (`_in_rounds`). The taken edges are the same.
    """
    from gristmill.operators.graph import stored

    order = [F.col(strength).desc_nulls_last(), F.col(src).asc_nulls_last(), F.col(dst).asc_nulls_last()]
    ranked = stored(edges.orderBy(*order).withColumn("_o", F.monotonically_increasing_id()))
    ends = [stored(ranked.select(F.struct(F.col(group).alias("g"), F.col(end).alias("e")).alias("_n")).distinct()) for end in (src, dst)]
    if not ends[0].join(ends[1], "_n", "left_semi").isEmpty():
        return _in_rounds(ranked.drop("_o"), group, src, dst, strength, k)
    few, many = (src, dst) if ends[0].count() < ends[1].count() else (dst, src)
    return _proposed(ranked, group, few, many, k).select(*edges.columns)


def _proposed(ranked: DataFrame, group: str, few: str, many: str, k: int) -> DataFrame:
    """degree_capped for ends of two kinds, by deferred acceptance; `_o` is an edge's place in the order.

    As all ends rank their edges by one order, what is taken one by one is the only stable choice: each end of `few` with room
    proposes its first edges that it has not proposed yet, each end of `many` holds its k first ones and lets the others go,
    until nobody has room and edges left. An edge behind the last one that a full end holds is skipped, as what an end holds
    only gets better. Edges of a proposing end lie in rows of LOOK, of which a round reads one row an end.
    """
    from gristmill.operators.graph import stored

    at = ranked.select(F.struct(F.col(group).alias("g"), F.col(few).alias("e")).alias("_p"), F.col(many).alias("_m"), "_o")
    at = at.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1)
    rows = at.groupBy("_p", F.floor(F.col("_i") / LOOK).cast("int").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_o", "_m"))).alias("_l"))
    rows = stored(rows.select("_p", "_b", F.col("_l._o").alias("_os"), F.col("_l._m").alias("_ms")))
    state = stored(rows.groupBy("_p").agg(F.sum(F.size("_os")).cast("int").alias("_n")).withColumn("_at", F.lit(0)))
    held = None
    while True:
        active = state.where("_at < _n").withColumn("_room", F.lit(k))
        if held is not None:
            own = held.groupBy("_p").agg(F.count("*").cast("int").alias("_c"))
            active = active.join(own, "_p", "left").withColumn("_room", F.lit(k) - F.coalesce("_c", F.lit(0))).drop("_c").where("_room > 0")
        active = stored(active.withColumn("_b", F.floor(F.col("_at") / LOOK).cast("int")))
        if active.isEmpty():
            break
        seen = active.join(rows, ["_p", "_b"]).select("_p", "_b", "_at", "_room", "_ms", F.posexplode("_os").alias("_k", "_o"))
        seen = seen.where(F.col("_b") * LOOK + F.col("_k") >= F.col("_at")).select("_p", "_b", "_k", "_room", "_o", F.struct(F.col("_p.g").alias("g"), F.get("_ms", F.col("_k")).alias("e")).alias("_r"))
        if held is not None:
            full = held.groupBy("_r").agg(F.count("*").alias("_c"), F.max("_o").alias("_last")).where(F.col("_c") >= k).drop("_c")
            seen = seen.join(full, "_r", "left").where("_last is null or _o < _last")
        first = seen.withColumn("_q", F.row_number().over(Window.partitionBy("_p").orderBy("_o"))).where("_q <= _room")
        first = stored(first.select("_p", "_r", "_o", "_b", "_k", "_room"))
        moved = first.groupBy("_p").agg(F.when(F.count("*") == F.first("_room"), F.max(F.col("_b") * LOOK + F.col("_k")) + 1).alias("_to"))
        moved = active.select("_p", "_b").join(moved, "_p", "left").select("_p", F.coalesce("_to", (F.col("_b") + 1) * LOOK).alias("_to"))
        state = stored(state.join(moved, "_p", "left").select("_p", "_n", F.coalesce("_to", "_at").alias("_at")))
        offers = first.select("_p", "_r", "_o")
        offers = offers if held is None else held.unionByName(offers)
        held = stored(offers.withColumn("_q", F.row_number().over(Window.partitionBy("_r").orderBy("_o"))).where(F.col("_q") <= k).drop("_q"))
    return ranked.limit(0) if held is None else ranked.join(held.select("_o"), "_o", "left_semi")


def _in_rounds(edges: DataFrame, group: str, src: str, dst: str, strength: str, k: int) -> DataFrame:
    """degree_capped for any ends.

    An edge that is among the first open ones of both its ends, as many as these have room
    for, is taken whatever the others do; then all edges of full ends go. A group's best open edge is
    taken in each round. No task holds a group: an end's edges are cut to k before they are shuffled.
    """
    from gristmill.operators.graph import stored

    order = [F.col(strength).desc_nulls_last(), F.col(src).asc_nulls_last(), F.col(dst).asc_nulls_last(), F.col("_e")]
    ends = lambda df: df.select("*", F.explode(F.array_distinct(F.array(src, dst))).alias("_n"))
    left = stored(edges.withColumn("_e", F.monotonically_increasing_id()))
    taken, used = left.limit(0), None
    while not left.isEmpty():
        one = ends(left).select("_e", group, strength, src, dst, "_n")
        first = one.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_n").orderBy(*order))).where(F.col("_r") <= k)
        room = F.lit(k)
        if used is not None:
            first = first.alias("f").join(used.alias("u"), F.expr(f"f.`{group}` <=> u._g and f._n <=> u._m"), "left").select("f.*", "_used")
            room = F.lit(k) - F.coalesce("_used", F.lit(0))
        sure = stored(first.where(F.col("_r") <= room).groupBy("_e").agg(F.count("*").alias("_c")))
        both = F.when(F.col(src).eqNullSafe(F.col(dst)), 1).otherwise(2)
        taken = stored(taken.unionByName(left.join(sure, "_e").where(F.col("_c") == both).drop("_c")))
        used = stored(ends(taken).groupBy(F.col(group).alias("_g"), F.col("_n").alias("_m")).agg(F.count("*").alias("_used")))
        full = used.where(F.col("_used") >= k)
        rest = left.join(taken.select("_e"), "_e", "left_anti").alias("l")
        for end in (src, dst):
            rest = rest.join(full, F.expr(f"l.`{group}` <=> _g and l.`{end}` <=> _m"), "left_anti").alias("l")
        left = stored(rest)
    return taken.select(*edges.columns)
