"""Sweeps over pairs against plain Python."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from gristmill.operators import joins


def test_best_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 2.0], None])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g string, v array<double>")

    def cosine(x, y):
        return round(sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5, 6)

    for same, k in ((None, 9), ("g", 9), ("g", 400), (None, 1)):
        every = [(-cosine(x[2], y[2]), x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[2] and y[2] and (same is None or (x[1] is not None and x[1] == y[1]))]
        want = [(a, b, -s) for s, a, b in sorted(every)[:k]]
        assert [(r["a"], r["b"], r["sim"]) for r in joins.best_pairs(df, "i", "v", k, same).collect()] == want
    assert joins.best_pairs(df.limit(0), "i", "v", 3).count() == 0


def test_pair_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["s", "t", None]), rng.choice([1, 2, 9, None])) for _ in range(80)] + [("alone", "s", 1)]
    df = spark.createDataFrame(rows, "g string, t string, n int")
    verdict = F.when((F.col("x.t") == F.col("y.t")) & (F.col("x.n") == F.col("y.n")), "same").when(F.abs(F.col("x.n") - F.col("y.n")) <= 1, "near").otherwise("far")

    def judged(x, y):
        known = x[2] is not None and y[2] is not None
        if x[1] is not None and x[1] == y[1] and known and x[2] == y[2]:
            return "same"
        return "near" if known and abs(x[2] - y[2]) <= 1 else "far"

    want = Counter(judged(x, y) for x, y in itertools.combinations(rows, 2) if x[0] is not None and x[0] == y[0])
    assert {r["verdict"]: int(r["n"]) for r in joins.pair_counts(df, "g", ["t", "n"], verdict).collect()} == want
    assert joins.pair_counts(df.limit(0), "g", ["t", "n"], verdict).count() == 0
