"""Exact percentiles by selection, band joins, quotes, value blocks and limiter runs against plain Python."""

import collections
import datetime
import math
import random

import pytest

from gristmill.operators import aggregates, joins, quotes
from gristmill.streaming import state


@pytest.mark.parametrize("few", [1, 40, 50_000])
def test_percentiles_by_selection(spark, monkeypatch, few):
    """A hot group, many equal values, outliers, nulls and a group of one; no group is sorted in a task unless it is small."""
    monkeypatch.setattr(aggregates, "FEW", few)
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, 1.5, rng.random(), rng.random() * 1e9, -1e-9])) for _ in range(4000)] + [("equal", 7.0)] * 900 + [(None, float(i)) for i in range(300)] + [("one", 2.5), ("none", None), ("hot", None)]
    got = {r.g: tuple(r)[1:] for r in aggregates.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}, "g").collect()}
    by = collections.defaultdict(list)
    for g, v in rows:
        by[g] += [] if v is None else [v]
    assert got == {g: tuple(sorted(v)[int(len(v) * s)] for s in (0.0, 0.5, 0.99)) for g, v in by.items() if v}
    alone = aggregates.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", {"p90": 0.9}).first()
    every = sorted(v for _, v in rows if v is not None)
    assert alone.p90 == every[int(len(every) * 0.9)]


def test_band_join(spark):
    rng = random.Random(5)
    rows = [(i, a := rng.uniform(-50, 50), None if i % 11 == 0 else a + rng.choice([0, 0.1, 3, 40, -1])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, start double, end double")
    near = joins.band_join(df, df, 2.0, 1.5)
    got = collections.Counter((r.x.id, r.y.id) for r in near.collect())
    good = [r for r in rows if r[2] is not None and r[1] <= r[2]]
    assert got == collections.Counter((x[0], y[0]) for x in good for y in good if max(x[1], y[1]) - min(x[2], y[2]) <= 2.0)
    plan = near._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_quotes(spark, monkeypatch):
    monkeypatch.setattr(quotes, "LETTERS", 20)
    texts = [(1, "The quick brown fox, he jumps."), (2, "quick brown foxes jump"), (3, None), (4, ""), (5, "a b a b c é ü"), (6, "über quick brownish")]
    asked = [(1, "quick brown fox"), (2, "brown"), (3, ""), (4, None), (5, "b a b"), (6, "ick brown fo"), (7, "é ü"), (8, "nowhere to be seen"), (9, "own"), (10, "brown"), (11, " brown ")]
    found = quotes.located(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "quote_id int, quote string"))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter((q, i) for q, quote in asked for i, t in texts if quote and t is not None and quote in t)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_blocks_of_a_full_value(spark, monkeypatch):
    monkeypatch.setattr(joins, "VALUE_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, v) for i in range(60) for v in {"all", rng.choice("xyz"), rng.choice("uvw")}] + [(None, "all"), (3, None), (3, "all")]
    want = collections.Counter()
    for v in "all x y z u v w".split():
        items = sorted({i for i, x in rows if x == v and i is not None})
        want.update((a, b) for k, a in enumerate(items) for b in items[k + 1 :])
    got = {(r.a, r.b): r.shared for r in joins.shared_attribute_pairs(spark.createDataFrame(rows, "k long, v string"), "k", "v").collect()}
    assert got == want


def test_limiter_runs(spark):
    """Admission per run of calls equals one pass over a user's whole history, also at exactly the window's length."""
    rng = random.Random(9)
    start, rows = datetime.datetime(2024, 1, 1), []
    for user in ("a", "b", None):
        t = start
        for k in range(120):
            t += datetime.timedelta(seconds=rng.choice([0, 1, 5, 59, 60, 61, 300]))
            rows.append((user, t, k))
    got = {(r.u, r.k): r.allowed for r in state.limiter(spark.createDataFrame(rows, "u string, t timestamp, k int"), "u", "t", "k", 2, 60).collect()}
    held = collections.defaultdict(list)
    for user, t, k in rows:
        own = [h for h in held[user] if h > t - datetime.timedelta(seconds=60)]
        assert got[user, k] == (len(own) < 2)
        held[user] = own + ([t] if len(own) < 2 else [])


def test_selection_sorts_no_large_group(spark):
    rows = spark.range(200_000).selectExpr("id % 2 as g", "cast(hash(id) as double) as v")
    got = {r.g: r.p50 for r in aggregates.nearest_rank(rows, "v", {"p50": 0.5}, "g").collect()}
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.g].append(r.v)
    assert got == {g: sorted(v)[math.floor(len(v) * 0.5)] for g, v in by.items()}
