"""The spectrum of large graphs: eigenvectors as table columns, products as joins, small matrices on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.graph import components, stored

#: Vectors beyond those asked for, which let the last ones converge.
GUARDS = 3


def largest_component(adjacency: DataFrame) -> DataFrame:
    """The rows (a, b, w) of the connected component with most nodes; of equal ones that with the smallest id."""
    roots = stored(components(adjacency.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct())
    top = roots.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "root").limit(1)
    held = roots.join(F.broadcast(top.select("root")), "root", "left_semi").select(F.col("id").alias("a"))  # one row
    return adjacency.where("a <> b").join(held, "a", "left_semi").select("a", "b", "w")


def _products(basis: DataFrame, width: int) -> np.ndarray:
    """The inner products of all columns of (id, v); tasks sum their rows' products, of which width x width reach the driver."""
    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["v"].to_numpy())
                total += rows.T @ rows
        yield pd.DataFrame({"at": np.arange(width * width), "x": total.ravel()})

    out = np.zeros(width * width)
    for at, x in basis.select("v").mapInPandas(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[at] = x
    return out.reshape(width, width)


def _combined(basis: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, x): the columns of (id, v) times a matrix."""
    def product(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "x": list(np.stack(batch["v"].to_numpy()) @ weights)})

    return basis.select("id", "v").mapInPandas(product, f"id {basis.schema['id'].dataType.simpleString()}, x array<double>")


def spectrum(adjacency: DataFrame, k: int, steps: int = 10, rounds: int = 12, tolerance: float = 1e-6) -> tuple[list[float], DataFrame, float]:
    """The k + 1 smallest eigenvalues of the normalised Laplacian, (id, x) with their vectors, and the largest residual.

    adjacency: (a, b, w), undirected and connected, a row for each pair in either direction (rows of a
    pair add up, loops don't count). A block of k + 1 + GUARDS vectors lies in a table with a row per
    node. A round appends `steps` Chebyshev products with the adjacency, each of which is a join with
    the links and a sum per node; the best vectors of their span (Rayleigh-Ritz) begin the next round.
    The driver sees inner products only, whose number does not depend on the graph. Rounds end when the
    residuals of the k + 1 vectors are under the tolerance; after `rounds` of them the residual says what was
    reached (an eigenvalue errs by its square over the gap). A graph with fewer than k + 1 nodes gives as many values as it has nodes. An empty graph gives none.
    """
    way = adjacency.where("a <> b").select("a", "b", F.col("w").cast("double").alias("w"))
    both = stored(way.unionByName(way.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    nodes = stored(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d")))
    n = nodes.count()
    if not n:
        return [], nodes.select("id", F.array().cast("array<double>").alias("x")), 0.0
    ends = [nodes.select(F.col("id").alias(c), F.col("d").alias(f"d{c}")) for c in "ab"]
    links = stored(both.join(ends[0], "a").join(ends[1], "b").select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w")))
    p = min(k + 1 + GUARDS, n)
    # The first vector is that of eigenvalue 0; the others are made from hashes, so that a lost task makes them again.
    noise = [F.xxhash64("id", F.lit(i)) / F.lit(2.0**63) for i in range(1, p)]
    block = nodes.select("id", F.array(F.sqrt("d"), *noise).alias("x"))
    values, residual = np.zeros(0), np.inf
    for _ in range(rounds):
        # Columns 0 to p-1 of v are T0, the next p T1 and so on: T1 = A T0, then T(j+1) = 2 A T(j) - T(j-1).
        basis = stored(block.select("id", F.col("x").alias("v")))
        for j in range(steps):
            last = basis.select(F.col("id").alias("b"), F.slice("v", j * p + 1, p).alias("x"))
            sums = links.join(last, "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("w") * F.col("x")[i]).alias(f"y{i}") for i in range(p)])
            new = [F.col(f"y{i}") if j == 0 else 2 * F.col(f"y{i}") - F.col("v")[(j - 1) * p + i] for i in range(p)]
            basis = stored(basis.join(sums, "id").select("id", F.concat("v", F.array(*new)).alias("v")))
        width = p * (steps + 1)
        gram = _products(basis, width)
        held = p * steps
        shift = np.zeros((width, held))  # A times the first blocks, in terms of all of them
        for j in range(steps):
            for i in range(p):
                if j == 0:
                    shift[p + i, i] = 1.0
                else:
                    shift[(j + 1) * p + i, j * p + i] = shift[(j - 1) * p + i, j * p + i] = 0.5
        size, axes = np.linalg.eigh(gram[:held, :held])
        sound = size > size[-1] * 1e-11
        whiten = axes[:, sound] / np.sqrt(size[sound])
        inner = whiten.T @ (gram[:held, :] @ shift) @ whiten
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(-found)[:p]
        values, weights = found[best], whiten @ turn[:, best]
        off = shift @ weights
        off[:held] -= weights * values
        misses = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", off, gram, off), 0.0))
        residual = float(misses[: k + 1].max())
        block = stored(_combined(basis, np.vstack([weights, np.zeros((width - held, weights.shape[1]))])))
        if residual < tolerance or len(values) < p:  # a smaller span holds all there is
            break
    asked = min(k + 1, len(values))
    return [float(1 - x) for x in values[:asked]], block.select("id", F.slice("x", 1, asked).alias("x")), residual


def spectral_communities(adjacency: DataFrame, k: int, vectors: int | None = None, seed: int = 3, tolerance: float = 1e-6) -> tuple[list[float], DataFrame]:
    """The eigenvalues of spectrum() on the largest component, and (id, side, community) of its nodes.

    Communities are k-means clusters of the `vectors` (k where not given) vectors after the first, named by their smallest node.
    side is the sign of the second vector, that of the smallest node being 1.
    """
    values, found, _ = spectrum(largest_component(adjacency), max(k, vectors or 0), tolerance=tolerance)
    rows = stored(found)
    if len(values) < 2:
        return values, rows.select("id", F.lit(1).alias("side"), F.col("id").alias("community"))
    points = rows.select("id", F.signum(F.col("x")[1]).cast("int").alias("side"), array_to_vector(F.slice("x", 2, min(vectors or k, len(values) - 1))).alias("features"))
    model = KMeans(k=min(k, len(values)), seed=seed, maxIter=50).fit(points)
    placed = stored(model.transform(points).select("id", "side", "prediction"))
    names = placed.groupBy("prediction").agg(F.min("id").alias("community"))
    first = placed.agg(F.min_by("side", "id").alias("f"))
    out = placed.join(F.broadcast(names), "prediction").join(F.broadcast(first))  # k rows and one row
    return values, out.select("id", F.when(F.col("side") == F.col("f"), 1).otherwise(-1).alias("side"), "community")
