"""Joins: equi-joins wherever the meaning allows; vector joins as matrix products of blocks with blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, rows of a tile: a task multiplies two blocks, tile by tile. A row is sent once for each block that it meets.
BLOCK, TILE = 32_768, 2_048


def pair(a: str, b: str) -> list[Column]:
    """An unordered pair in its canonical order, as columns a and b."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def either_end(edges: DataFrame, ids: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges with an end among the ids: two semi-joins, so that no nested loop is planned."""
    one = edges.join(ids.select(F.col(key).alias(src)), src, "left_semi").select(edges.columns)
    two = edges.join(ids.select(F.col(key).alias(dst)), dst, "left_semi").select(edges.columns)
    return one.unionByName(two).distinct()


def both_ends(edges: DataFrame, ids: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    return edges.join(ids.select(F.col(key).alias(src)), src, "left_semi").join(ids.select(F.col(key).alias(dst)), dst, "left_semi").select(edges.columns)


def no_end(nodes: DataFrame, edges: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Nodes with no edge at either end; ends that are null match nothing."""
    ends = edges.select(F.col(src).alias(key)).unionByName(edges.select(F.col(dst).alias(key)))
    return nodes.join(ends, key, "left_anti")


#: Items of a value up to which they are paired in one task; a fuller value is dealt in blocks.
VALUE_ROWS = 1_000


def shared_attribute_pairs(bridge: DataFrame, item: str, attribute: str, salt: int = 1) -> DataFrame:
    """(a, b, shared) of items a < b with a common attribute value and the number of common values.

    An item is sent, for each of its values, with the list of the value's later items, so that what is shuffled is a number a
    pair; pairs are made and counted where their first item is. A value with more than VALUE_ROWS items is cut along the items
    into blocks of about that many, and lists are of one block, so that no list is long. With salt > 1
    every value has at least so many blocks.
    """
    rows = bridge.select(F.col(item).alias("_i"), F.col(attribute).alias("_v")).where("_i is not null and _v is not null").distinct()
    value = Window.partitionBy("_v")
    rows = rows.withColumn("_r", F.row_number().over(value.orderBy("_i")) - 1).withColumn("_n", F.count("*").over(value))
    at = F.floor(F.col("_r") * F.greatest(F.ceil(F.col("_n") / VALUE_ROWS), F.lit(salt)) / F.col("_n")).cast("int")
    lists = rows.groupBy("_v", at.alias("_at")).agg(F.sort_array(F.collect_list("_i")).alias("_l"), F.first("_n").alias("_n"))
    own = lists.where(F.size("_l") > 1).select("_l", F.posexplode("_l").alias("_k", "a")).where(F.col("_k") + 1 < F.size("_l"))
    own = own.select("a", F.slice("_l", F.col("_k") + 2, F.size("_l") - F.col("_k") - 1).alias("_later"))
    many = lists.where((F.col("_n") > VALUE_ROWS) | F.lit(salt > 1)).drop("_n")
    later = many.alias("x").join(many.alias("y"), F.expr("x._v = y._v and x._at < y._at")).select(F.explode("x._l").alias("a"), F.col("y._l").alias("_later"))
    sent = own.unionByName(later).repartition("a")
    return sent.select("a", F.explode("_later").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def band_join(left: DataFrame, right: DataFrame, tolerance: float, width: float) -> DataFrame:
    """Rows (x: left, y: right) whose intervals [start, end] are at most `tolerance` apart; no key is equal, no nested loop is planned.

    Both have columns start and end; rows with a null end, or an end before their start, meet nothing. An
    interval stands in each cell of `width` that it touches, the left one widened by the tolerance; a
    pair meets in the first cell that both have and nowhere else. A width near the usual length of the
    intervals keeps copies few.
    """
    cell = lambda c: F.floor(c / F.lit(float(width)))
    whole = "start is not null and end is not null and start <= end"
    one = left.where(whole).select(F.struct(*left.columns).alias("x"), cell(F.col("start") - tolerance).alias("_xa"), cell(F.col("end") + tolerance).alias("_xb"))
    two = right.where(whole).select(F.struct(*right.columns).alias("y"), cell(F.col("start")).alias("_ya"), cell(F.col("end")).alias("_yb"))
    one = one.select("x", "_xa", F.explode(F.sequence("_xa", "_xb")).alias("_cell"))
    two = two.select("y", "_ya", F.explode(F.sequence("_ya", "_yb")).alias("_cell"))
    gap = F.greatest("x.start", "y.start") - F.least("x.end", "y.end")
    return one.join(two, "_cell").where((F.col("_cell") == F.greatest("_xa", "_ya")) & (gap <= tolerance)).select("x", "y")


#: Rows of a group of which each meets each in one task.
PAIR_ROWS = 1_000


def pairs_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows x and y of equal keys with x.order < y.order, as aliases of one join.

    A group is cut along the order into blocks of PAIR_ROWS, and a block meets itself and later ones, so that of what is compared
    nearly all is in order, and a large group's pairs are many tasks'. Null keys and null orders meet nothing.
    """
    group = Window.partitionBy(*keys)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, order]))
    rows = rows.withColumn("_at", F.floor((F.row_number().over(group.orderBy(order)) - 1) / PAIR_ROWS).cast("int")).withColumn("_last", F.floor((F.count("*").over(group) - 1) / PAIR_ROWS).cast("int"))
    x = rows.withColumn("_i", F.col("_at")).withColumn("_j", F.explode(F.sequence("_at", "_last")))
    y = rows.withColumn("_j", F.col("_at")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_at"))))
    met = " and ".join(f"x.`{c}` = y.`{c}`" for c in [*keys, "_i", "_j"])
    return x.drop("_at", "_last").alias("x").join(y.drop("_at", "_last").alias("y"), F.expr(f"{met} and x.`{order}` < y.`{order}`"))


def band_pairs(df: DataFrame, key: str, tolerance: float, width: float) -> DataFrame:
    """Rows x and y, x.key < y.key, of one table whose intervals [start, end] are at most `tolerance` apart, as aliases of one join.

    As band_join, but each pair is looked at once: both intervals are widened by half the tolerance (and a little, for rounding).
    """
    more = lambda c: F.lit(tolerance / 2) + (F.abs(c) + tolerance) * 1e-9
    cell = lambda c: F.floor(c / F.lit(float(width)))
    rows = df.where("start is not null and end is not null and start <= end")
    rows = rows.withColumn("_a", cell(F.col("start") - more(F.col("start")))).withColumn("_cell", F.explode(F.sequence("_a", cell(F.col("end") + more(F.col("end"))))))
    gap = F.greatest("x.start", "y.start") - F.least("x.end", "y.end")
    return pairs_in_order(rows, ["_cell"], key).where((F.col("x._cell") == F.greatest("x._a", "y._a")) & (gap <= tolerance))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors as rows; a shorter vector or a null in it makes all its products NaN."""
    vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-12)[:, None]


def _firsts(x: np.ndarray, y: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each x the k pairs of largest sim, of equal ones those of smaller y, and their ranks from 0."""
    order = np.lexsort((y, -sim, x))
    x, y, sim = x[order], y[order], sim[order]
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    rank = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
    keep = rank < k
    return x[keep], y[keep], sim[keep], rank[keep]


def _best(tiles: Iterator[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, good: Callable, k: int | None, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, sim) of the tiles of a @ b.T, tile by tile: all good pairs with sim >= least, or each x's k best at the end.

    With k, a row's floor is what k of its pairs reach already, so that of later tiles few pairs are looked at. Floors lie one unit
    of rounding below.
    """
    floor = np.full(len(a), -np.inf if least is None else least - 1e-6)
    parts, pending = [], 0
    for rows, cols in tiles:
        sim = a[rows] @ b[cols].T
        high = sim >= floor[rows][:, None]  # never of NaN
        if k is not None and len(cols) > k and np.count_nonzero(high) > 8 * k * len(rows):
            high &= good(rows[:, None], cols[None, :])
            top = np.partition(np.where(high, sim, -np.inf), len(cols) - k, axis=1)[:, len(cols) - k]
            floor[rows] = np.maximum(floor[rows], top - 1e-6)
            high &= sim >= floor[rows][:, None]
        i, j = np.nonzero(high)
        x, y, s = rows[i], cols[j], np.round(sim[i, j], 6)
        keep = good(x, y) if least is None else good(x, y) & (s >= least)
        if k is None:
            yield x[keep], y[keep], s[keep]
            continue
        parts.append((x[keep], y[keep], s[keep]))
        pending += len(parts[-1][0])
        if pending > TILE * TILE // 8:
            *held, rank = _firsts(*map(np.concatenate, zip(*parts, strict=True)), k)
            last = rank == k - 1
            floor[held[0][last]] = np.maximum(floor[held[0][last]], held[2][last] - 1e-6)
            parts, pending = [tuple(held)], 0
    if parts:
        yield _firsts(*map(np.concatenate, zip(*parts, strict=True)), k)[:3]


def _tiles(n: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, n, TILE):
        for j in range(0, m, TILE):
            yield np.arange(i, min(i + TILE, n)), np.arange(j, min(j + TILE, m))


def swept(left: DataFrame, right: DataFrame, k: int | None, least: float | None, halves: bool = False, tiles: Callable | None = None) -> DataFrame:
    """(q, n, sim) of the rows of both sides (_k, _v, _o, _x) that meet at equal (_g, _i, _j): all with sim >= least, or each q's k best there.

    _o: a group that two rows must not share, unless it is null in the whole table; halves: where _i = _j, q < n only. `tiles` of the key and
    both sides' _x says which rows and columns are multiplied, else all are. A task holds two blocks and one tile of products.
    """
    kind = right.schema["_k"].dataType.simpleString()
    schema = pa.schema([("q", _arrow(kind)), ("n", _arrow(kind)), ("sim", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        one, two = table.filter(table.column("_left")), table.filter(pa.compute.invert(table.column("_left"))).sort_by("_k")  # ties are broken by place
        if not len(one) or not len(two):
            return
        a, b = _matrix(one.column("_v")), _matrix(two.column("_v"))
        if a.shape[1] != b.shape[1]:
            return
        q, n = one.column("_k").to_numpy(), two.column("_k").to_numpy()
        if q.dtype == object:  # compared as numbers
            codes = np.unique(np.concatenate([q, n]), return_inverse=True)[1]
            q, n = codes[: len(q)], codes[len(q) :]
        o, u = (None, None) if one.column("_o").null_count else (one.column("_o").to_numpy(), two.column("_o").to_numpy())
        half = halves and key[1].as_py() == key[2].as_py()

        def good(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = q[x] < n[y] if half else q[x] != n[y]
            return out if o is None else out & (o[x] != u[y])

        at = _tiles(len(q), len(n)) if tiles is None else tiles(key, one.column("_x"), two.column("_x"))
        for x, y, sim in _best(at, a, b, good, k, least):
            yield pa.RecordBatch.from_arrays([one.column("_k").take(pa.array(x)).combine_chunks(), two.column("_k").take(pa.array(y)).combine_chunks(), pa.array(sim)], schema=schema)

    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)))
    return both.groupBy("_g", "_i", "_j").applyInArrow(run, f"q {kind}, n {kind}, sim double")


def sided(df: DataFrame, key: str, vector: str, group: str | None, *more: Column) -> DataFrame:
    """(_k, _v, _o and more) of rows with a vector (and a group): what `swept` reads, vectors in their own precision."""
    kind = df.schema[vector].dataType.simpleString()
    out = df.select(F.col(key).alias("_k"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("_v"), (F.col(group) if group else F.lit(None).cast("int")).alias("_o"), *more)
    return out.where("_v is not null and _o is not null" if group else "_v is not null")


def blocks(n: Column) -> Column:
    """Blocks of n rows: of BLOCK at most on average, and four of a small table, for tasks to share."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(4), F.ceil(n / TILE))).cast("int")


def _products(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int | None, least: float | None, group: str | None = None, same: str | None = None, halves: bool = False) -> DataFrame:
    """(q, n, sim) of different rows, each block of queries times each block of the base, inside a group if `same` is given.

    Blocks are of a fixed size, dealt by a hash of the key, so that a task's memory is bounded whatever
    the sizes of tables and groups; a row is sent once for each block that it meets, which makes n * n / BLOCK rows.
    """
    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = sided(df, key, vector, group, (F.col(same) if same else F.lit(0)).alias("_g"), F.lit(None).cast("binary").alias("_x")).where("_g is not null")
        return rows, rows.groupBy("_g").agg(blocks(F.count("*")).alias(name))

    (left, lefts), (right, rights) = dealt(queries, "_is"), dealt(base, "_js")
    sizes = lefts.join(rights, "_g")
    left = left.join(sizes, "_g").withColumn("_i", F.pmod(F.xxhash64("_k"), F.col("_is")).cast("int"))
    right = right.join(sizes, "_g").withColumn("_j", F.pmod(F.xxhash64("_k"), F.col("_js")).cast("int"))
    left = left.withColumn("_j", F.explode(F.sequence(F.col("_i") if halves else F.lit(0), F.col("_js") - 1)))
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j") if halves else F.col("_is") - 1)))
    return swept(left.drop("_is", "_js"), right.drop("_is", "_js"), k, least, halves)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def knn(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, group: str | None = None, least: float | None = None) -> DataFrame:
    """(q, n, sim, rank): for each query row its k most similar base rows, itself left out; with `group` only rows of other groups.

    A block keeps k rows for each query, so that no more than k rows a query and block are ranked. Keys
    are integers or strings; rows with a null vector, or a null in it, match nothing.
    """
    scored = _products(queries, base, key, vector, k, least, group)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "n"))).where(F.col("rank") <= k)


def unordered(pairs: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *rest).distinct()


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, same: str | None = None) -> DataFrame:
    """(a, b, sim) of rows a < b with a similarity of at least `least`, within a group if `same` is given; keys are unique."""
    return _products(df, df, key, vector, None, least, same=same, halves=True).select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"), "sim")


def best_pairs(df: DataFrame, key: str, vector: str, k: int, same: str | None = None) -> DataFrame:
    """(a, b, sim): the k most similar pairs a < b, within a group if `same` is given; of equal ones those of smaller keys.

    A row passes on its k best partners of each block only: whatever goes before one of these for the row goes before it in
    the whole order as well. Keys are unique; rows with a null vector, or a null in it, make no pair.
    """
    near = _products(df, df, key, vector, k, None, same=same, halves=True)
    return near.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"), "sim").orderBy(F.col("sim").desc(), "a", "b").limit(k)


def pair_counts(df: DataFrame, group: str, attributes: list[str], verdict: Column, key: str | None = None) -> DataFrame:
    """(verdict, n): how many pairs of rows of a group have each verdict, without making the pairs.

    The verdict is symmetric and speaks of x.<attribute> and y.<attribute> only, so that rows with equal attributes count as one
    with a number: what is joined are the different values of a group. Rows of a null group make no pair; null attributes are
    equal to each other as values. n is a decimal, as pairs of large groups exceed a long. With `key` only rows of different
    keys make a pair, and none of a null key: pairs within a key are counted alike, over keys that repeat, and taken off.
    """
    if key is not None:
        df = df.where(F.col(key).isNotNull())
        often = df.groupBy(group, key).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
        within = pair_counts(df.join(often, [group, key]).withColumn("_of", F.struct(group, key)), "_of", attributes, verdict)
        both = pair_counts(df, group, attributes, verdict).unionByName(within.withColumn("n", -F.col("n")))
        return both.groupBy("verdict").agg(F.sum("n").cast("decimal(38,0)").alias("n")).where("n > 0")
    kinds = df.where(F.col(group).isNotNull()).groupBy(group, *attributes).agg(F.count("*").alias("_n"))
    x, y = F.col("x._n").cast("decimal(19,0)"), F.col("y._n").cast("decimal(19,0)")
    equal = F.lit(True)
    for name in attributes:
        equal = equal & F.col(f"x.{name}").eqNullSafe(F.col(f"y.{name}"))
    both = kinds.alias("x").join(kinds.alias("y"), F.col(f"x.{group}") == F.col(f"y.{group}"))
    ordered = both.select(verdict.alias("verdict"), (x * F.when(equal, y - 1).otherwise(y)).alias("_p"))  # each pair twice
    return ordered.groupBy("verdict").agg((F.sum("_p") / 2).cast("decimal(38,0)").alias("n")).where("n > 0")


def new_pairs(df: DataFrame, new: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Similar pairs with at least one new end: new x all, canonical, distinct."""
    fresh = df.join(new.select(key), key, "left_semi")
    return unordered(_products(fresh, df, key, vector, None, least), "q", "n", "sim")


def best_child(parents: DataFrame, children: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Left join with each parent's first child in the order."""
    first = children.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(key, *keep)
    return parents.join(first, key, "left")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Left join with the number of children, 0 if there is none."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def interval_relation(a0: Column, a1: Column, b0: Column, b1: Column, near: int = 5, far: int = 20) -> Column:
    """overlap within `near`, near within `far`, far beyond, unknown if an end is missing."""
    gap = F.greatest(a0, b0) - F.least(a1, b1)
    return F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), "unknown").when(gap <= near, "overlap").when(gap <= far, "near").otherwise("far")
