"""Approximate vector joins by an inverted file: every row in the list of its nearest centroid, queries probe a few lists.

Centroids are fitted on a bounded sample (SAMPLE rows, the first by a hash of the key), with k-means of
unit vectors; every row is assigned. Lists stand together on shelves of a block's size, so that a query is sent
once for each shelf and not for each list, and a full list is many tasks; within a task only the lists that
a query probes are multiplied; similarities are those of the exact join. More probes
give more recall and more work: `probed` says how many pairs a join compares.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import joins as J
from gristmill.operators.graph import stored

#: Rows that centroids are fitted on, rounds of k-means, rows that a list should have.
SAMPLE, ROUNDS, LIST_ROWS, MOST_LISTS = 20_000, 12, 64, 4_096


@dataclass
class Lists:
    """rows: the indexed columns and _list; centroids: one unit vector a list; first, parts: a list's shelves, held: a shelf's lists.

    A shelf is some whole lists of joins.BLOCK rows together, or a part of a list that alone has more.
    """

    rows: DataFrame
    centroids: np.ndarray
    key: str
    vector: str
    first: np.ndarray
    parts: np.ndarray
    held: list[np.ndarray]


def _shelves(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Shelves of lists of these sizes: neighbours in number together."""
    first, parts, held, room = np.zeros(len(sizes), int), np.ones(len(sizes), int), [], 0
    for i, n in enumerate(sizes.tolist()):
        if n > J.BLOCK:
            first[i], parts[i], room = len(held), -(-n // J.BLOCK), 0
            held += [[i]] * int(parts[i])
            continue
        if not held or n > room:
            held.append([])
            room = J.BLOCK
        held[-1].append(i)
        first[i], room = len(held) - 1, room - n
    return first, parts, [np.array(x) for x in held]


def _fit(vectors: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        centroids[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centroids


def _nearest(df: DataFrame, vector: str, centroids: np.ndarray, n: int) -> DataFrame:
    """df with _list and _probe (from 0), n times: the lists of a row's nearest centroids; rows without a full vector are left out. With n = 0 the rows alone."""
    width = centroids.shape[1] if len(centroids) else 0
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()))
    if n == 0:
        return rows
    held = df.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = J._matrix(pa.chunked_array([batch.column(batch.schema.get_field_index(vector))])) @ held.value.T if batch.num_rows else np.zeros((0, 1))
            take = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
            for row in range(take.shape[1]):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(take[:, row]), pa.array(np.full(len(take), row, np.int32))], names=[*batch.schema.names, "_list", "_probe"])

    return rows.mapInArrow(probe, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, _list int, _probe int")


def build(df: DataFrame, key: str, vector: str, group: str | None = None) -> Lists:
    """The index of all rows with a vector; key: unique integers or strings."""
    kind = df.schema[vector].dataType.simpleString()
    rows = df.select(key, F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias(vector), *([group] if group else []))
    n = rows.count()
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow()
    full = J._matrix(sample.column(vector)) if sample.num_rows else np.zeros((0, 0))
    full = full[~np.isnan(full).any(1)]
    centroids = _fit(full, max(1, min(MOST_LISTS, n // LIST_ROWS))) if len(full) else np.zeros((0, 0))
    rows = stored(_nearest(rows, vector, centroids, 1).drop("_probe"))
    sizes = np.zeros(max(1, len(centroids)), int)
    for r in rows.groupBy("_list").count().collect():  # a row for each list at most
        sizes[r._list] = r["count"]
    return Lists(rows, centroids, key, vector, *_shelves(sizes))


def _asked(queries: DataFrame, lists: Lists, probes: int, group: str | None) -> DataFrame:
    """Query rows for `swept`, one for each shelf that holds a list which they probe; _x tells which of the shelf's lists, a bit each."""
    sides = J.sided(_nearest(queries, lists.vector, lists.centroids, 0), lists.key, lists.vector, group)
    held = queries.sparkSession.sparkContext.broadcast((lists.centroids, lists.held))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, shelves = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = J._matrix(pa.chunked_array([batch.column("_v")])) @ centroids.T
            asked = np.zeros(scores.shape, bool)
            np.put_along_axis(asked, np.argsort(-scores, axis=1, kind="stable")[:, :probes], True, axis=1)
            for shelf, own in enumerate(shelves):
                at = np.flatnonzero(asked[:, own].any(1))
                if len(at):
                    bits = np.packbits(asked[at][:, own], axis=1)
                    binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.py_buffer(bits.tobytes())])
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), shelf, np.int32)), binary], names=[*batch.schema.names, "_j", "_x"])

    return sides.mapInArrow(probe, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sides.schema.fields)}, _j int, _x binary")


def _joined(queries: DataFrame, lists: Lists, probes: int, k: int | None, least: float | None, group: str | None = None) -> DataFrame:
    """(q, n, sim) of queries and the rows in the lists that they probe: a query is sent once for each shelf, a row once for each block of queries."""
    spark, shelves = queries.sparkSession, lists.held
    n = max(1, -(-queries.count() // J.BLOCK))
    asked = _asked(queries, lists, probes, group).withColumn("_g", F.lit(0)).withColumn("_i", F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int"))
    at = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(lists.first, lists.parts, strict=True))], "_list int, _first int, _parts int")
    base = J.sided(lists.rows, lists.key, lists.vector, group, "_list").join(F.broadcast(at), "_list")
    base = base.withColumn("_j", (F.col("_first") + F.pmod(F.xxhash64("_k"), F.col("_parts"))).cast("int")).withColumn("_x", F.encode(F.col("_list").cast("string"), "utf-8"))
    base = base.withColumn("_g", F.lit(0)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).drop("_list", "_first", "_parts")

    def tiles(key: tuple[pa.Scalar, ...], left: pa.ChunkedArray, right: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.unpackbits(np.frombuffer(b"".join(left.to_pylist()), np.uint8).reshape(len(left), -1), axis=1)
        own = np.array([int(x) for x in right.to_pylist()])
        by = np.argsort(own, kind="stable")  # each list's rows stay in the order of their keys
        lists = shelves[key[2].as_py()]
        starts, ends = (np.searchsorted(own[by], lists, side) for side in ("left", "right"))
        for place, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            cols, rows = by[start:end], np.flatnonzero(bits[:, place])
            for x in range(0, len(rows), step := max(1, J.TILE * J.TILE // max(1, min(len(cols), J.TILE)))):
                for y in range(0, len(cols), J.TILE):
                    yield rows[x : x + step], cols[y : y + J.TILE]

    return J.swept(asked, base, k, least, tiles=tiles)


def knn(lists: Lists, queries: DataFrame, k: int, probes: int, group: str | None = None) -> DataFrame:
    """(q, n, sim, rank) as the exact knn gives them, of the rows in each query's nearest `probes` lists; rows with `group` equal are left out."""
    scored = _joined(queries, lists, probes, k, None, group)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "n"))).where(F.col("rank") <= k)


def similar_pairs(lists: Lists, least: float, probes: int) -> DataFrame:
    """(a, b, sim) of rows a < b with a similarity of at least `least`, of which one is in a list that the other probes."""
    return J.unordered(_joined(lists.rows, lists, probes, None, least), "q", "n", "sim")


def probes_for(lists: Lists, k: int | None = None, least: float | None = None, group: str | None = None, recall: float = 0.95, asked: int = 256) -> int:
    """The fewest probes that find the given share of the exact neighbours of `asked` rows, the first by a hash of the key.

    A bounded set of queries meets all rows once; of each true neighbour counts how far down its list is among the query's.
    """
    rows = lists.rows.drop("_list")
    sample = stored(rows.orderBy(F.xxhash64(lists.key), lists.key).limit(asked))
    exact = J.knn(sample, rows, lists.key, lists.vector, k, group) if k else J._products(sample, rows, lists.key, lists.vector, None, least, group)
    at = _nearest(sample, lists.vector, lists.centroids, max(1, len(lists.centroids))).select(F.col(lists.key).alias("q"), "_list", "_probe")
    own = exact.select("q", "n").join(lists.rows.select(F.col(lists.key).alias("n"), "_list"), "n").join(at, ["q", "_list"])
    counts = own.groupBy("_probe").agg(F.count("*").alias("c")).orderBy("_probe").collect()  # a row for each list at most
    wanted, seen = recall * sum(r.c for r in counts), 0
    for r in counts:
        seen += r.c
        if seen >= wanted:
            return r._probe + 1
    return 1


def probed(lists: Lists, probes: int) -> int:
    """Pairs that similar_pairs or a knn of all rows compares."""
    sizes = lists.rows.groupBy("_list").agg(F.count("*").alias("_n"))
    asked = _nearest(lists.rows.drop("_list"), lists.vector, lists.centroids, probes).groupBy("_list").agg(F.count("*").alias("_q"))
    return sizes.join(asked, "_list").agg(F.sum(F.col("_n") * F.col("_q"))).first()[0] or 0
