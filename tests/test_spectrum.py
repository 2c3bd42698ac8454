"""The spectrum by joins against the dense one, and communities of planted parts."""

import random

import numpy as np
import pytest

from gristmill.operators import spectrum as P

LINKS = "a long, b long, w double"


def dense(rows):
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {x: i for i, x in enumerate(ids)}
    full = np.zeros((len(ids), len(ids)))
    for a, b, w in rows:
        if a != b:
            full[at[a], at[b]] += w
            full[at[b], at[a]] += w
    d = full.sum(axis=1)
    return ids, full / np.sqrt(np.outer(d, d))


def planted(parts, size, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(parts):
        own = range(g * size, (g + 1) * size)
        rows += [(a, b, 1.0 + rng.random()) for a in own for b in own if a < b and rng.random() < 0.5]
        rows += [(a, a + 1, 1.0) for a in own if a + 1 < (g + 1) * size]
    rows += [(g * size, (g + 1) % parts * size + 1, 0.1) for g in range(parts)]
    return rows


def test_values_and_vectors_equal_the_dense_ones(spark):
    rows = planted(4, 12, 1) + [(3, 3, 9.0), (0, 1, 0.5), (1, 0, 0.25)]  # a loop, and a pair in both directions
    ids, a = dense(rows)
    want = np.sort(1 - np.linalg.eigvalsh(a))[:5]
    values, vectors, residual = P.spectrum(spark.createDataFrame(rows, LINKS), 4)
    assert residual < 1e-6 and values == pytest.approx(want, abs=1e-7)
    x = dict(vectors.collect())
    got = np.array([x[i] for i in ids])
    assert np.abs(got.T @ got - np.eye(5)).max() < 1e-6
    assert np.abs(a @ got - got * (1 - want)).max() < 1e-5


def test_communities_of_the_largest_component(spark):
    rows = planted(3, 14, 2) + [(1000 + i, 1001 + i, 5.0) for i in range(10)]
    values, placed = P.spectral_communities(spark.createDataFrame(rows, LINKS), 3, vectors=2)
    found = {r["id"]: r["community"] for r in placed.collect()}
    assert found == {i: i // 14 * 14 for i in range(42)}  # the other component is left out
    assert values[0] == pytest.approx(0, abs=1e-9) and 0 < values[1] < 0.1
    sides = {r["id"]: r["side"] for r in placed.collect()}
    assert sides[0] == 1 and set(sides.values()) == {1, -1}


@pytest.mark.parametrize("rows, count", [([], 0), ([(1, 2, 1.0)], 2), ([(1, 2, 1.0), (2, 3, 1.0), (1, 2, 1.0)], 3)])
def test_tiny_graphs(spark, rows, count):
    values, placed = P.spectral_communities(spark.createDataFrame(rows, LINKS), 3)
    assert placed.count() == count and len(values) == count
    if rows:
        _, a = dense(rows)
        assert values == pytest.approx(np.sort(1 - np.linalg.eigvalsh(a)), abs=1e-7)
