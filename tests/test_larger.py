"""Operators whose first form was right but too dear on large tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ivf, joins, topk


@pytest.mark.parametrize("look, sides", [(2, (9, 25)), (16, (25, 9))])
def test_degree_cap_of_two_kinds_of_ends(spark, monkeypatch, look, sides):
    """Proposals give the edges of one pass, also with null ends, groups and strengths and with repeated edges; no round goes over all open edges."""
    monkeypatch.setattr(topk, "LOOK", look)
    monkeypatch.setattr(topk, "_in_rounds", None)
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(sides[0])]), -1 - rng.randrange(sides[1]), rng.choice([1, 1, 1, 2, None])) for _ in range(500)]
    want = []
    for g in (1, 2, None):
        degree = collections.Counter()
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3] is None, -(r[3] or 0), r[1] is None, r[1] or 0, r[2])):
            if degree[r[1]] < 2 and degree[r[2]] < 2:
                want.append(r)
                degree.update(r[1:3])
    got = topk.degree_capped(spark.createDataFrame(rows, "g long, src long, dst long, w long"), "g", "src", "dst", "w", 2)
    assert got.columns == ["g", "src", "dst", "w"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_vector_is_sent_few_times(spark):
    """600,000 vectors are 19 blocks; a small table is shared by four tasks a side."""
    n = spark.createDataFrame([(600_000,), (51_282,), (5_000,), (3,)], "n long")
    assert [r[0] for r in n.select(joins.blocks(F.col("n"))).collect()] == [19, 4, 3, 1]


@pytest.mark.parametrize("k, block, tile", [(3, 40, 7), (1, 1000, 16), (50, 33, 5)])
def test_best_of_tiles(spark, monkeypatch, k, block, tile):
    """Many ties, null vectors, nulls in vectors, null groups and string keys, over blocks of several tiles."""
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "TILE", tile)
    rng = random.Random(6)
    rows = [(f"k{i}", [float(rng.choice([-1, 0, 1])) + (0.1 if rng.random() < 0.5 else 0) for _ in range(3)], rng.choice([1, 2, None])) for i in range(120)] + [("n", None, 1), ("h", [1.0, None, 2.0], 1)]
    df = spark.createDataFrame(rows, "id string, v array<double>, g int")
    norm = {i: sum(x * x for x in v) ** 0.5 for i, v, _ in rows[:120]}
    cos = lambda x, y: round(sum(p * q for p, q in zip(x[1], y[1])) / max(norm[x[0]], 1e-12) / max(norm[y[0]], 1e-12), 5)
    for group in (None, "g"):
        want = collections.defaultdict(list)
        for x in rows[:120]:
            sims = sorted((cos(x, y) for y in rows[:120] if x[0] != y[0] and (group is None or None not in (x[2], y[2]) and x[2] != y[2])), reverse=True)
            want[x[0]] = sims[:k]
        got = collections.defaultdict(list)
        for r in joins.knn(df, df, "id", "v", k, group).orderBy("q", "rank").collect():
            got[r.q].append(round(r.sim, 5))
        assert {q: pytest.approx(s, abs=2e-5) for q, s in want.items() if s} == got
        order = [(r.q, -r.sim, r.n) for r in joins.knn(df, df, "id", "v", k, group).orderBy("q", "rank").collect()]
        assert order == sorted(order)


def _shelved(spark, monkeypatch):
    """300 vectors of which half are in one list, on shelves of 40 rows."""
    monkeypatch.setattr(joins, "BLOCK", 40)
    monkeypatch.setattr(joins, "TILE", 16)
    monkeypatch.setattr(ivf, "LIST_ROWS", 30)
    rng = random.Random(7)
    rows = [(i, [5 + rng.gauss(0, 0.01), 1.0, rng.gauss(0, 0.01)] if i % 2 else [rng.gauss(0, 1) for _ in range(3)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    lists = ivf.build(df, "id", "v", "g")
    assert max(lists.parts) > 1 and len(lists.held) > 3
    return df, lists


def test_an_asked_vector_is_sent_once_a_shelf(spark, monkeypatch):
    df, lists = _shelved(spark, monkeypatch)
    every = len(lists.centroids)
    assert ivf._asked(df, lists, every, None).count() == 300 * len(lists.held)
    assert ivf._asked(df, lists, 1, None).groupBy("_k").count().where(F.col("count") > max(lists.parts)).isEmpty()
    assert {tuple(r) for r in ivf.knn(lists, df, 4, every).collect()} == {tuple(r) for r in joins.knn(df, df, "id", "v", 4).collect()}


def test_indexed_pairs_over_shelves(spark, monkeypatch):
    """Every pair of the dense list, whose rows lie on several shelves; no list's rows are sent with each query."""
    df, lists = _shelved(spark, monkeypatch)
    pairs = ivf.similar_pairs(lists, 0.9, len(lists.centroids))
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in joins.similar_pairs(df, "id", "v", 0.9).collect()}
    assert "_list" not in pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[1].split("\n")[0]


def test_indexed_neighbours_of_other_groups_over_shelves(spark, monkeypatch):
    """Of other groups only, and none for rows without a group."""
    df, lists = _shelved(spark, monkeypatch)
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    lists.rows = lists.rows.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = {tuple(r) for r in ivf.knn(lists, df, 3, len(lists.centroids), "g").collect()}
    assert got == {tuple(r) for r in joins.knn(df, df, "id", "v", 3, "g").collect()} and {r[0] % 3 for r in got} == {1, 2}


def test_band_pairs_look_at_a_pair_once(spark, monkeypatch):
    """Gaps of exactly the tolerance, long and empty intervals, nulls, equal keys; blocks of a cell meet once, in order."""
    monkeypatch.setattr(joins, "PAIR_ROWS", 5)
    rng = random.Random(5)
    rows = [(i % 280, a := round(rng.uniform(-20, 20), 1), None if i % 11 == 0 else a + rng.choice([0.0, 0.1, 3.0, 40.0, -1.0])) for i in range(300)] + [(None, 0.0, 1.0), (301, 1e6, 1e6), (302, 1e6 + 2, 1e6 + 3), (303, None, 2.0)]
    near = joins.band_pairs(spark.createDataFrame(rows, "id int, start double, end double"), "id", 2.0, 1.5)
    got = collections.Counter(tuple(r) for r in near.selectExpr("x.id", "x.start", "y.id", "y.start").collect())
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    assert got == collections.Counter((x[0], x[1], y[0], y[1]) for x in good for y in good if x[0] < y[0] and max(x[1], y[1]) - min(x[2], y[2]) <= 2.0)
    ordered = joins.pairs_in_order(spark.range(100).selectExpr("id % 1 as g", "id"), ["g"], "id")
    assert ordered.count() == 4950 and ordered.groupBy("x._i", "x._j").count().count() == 20 * 21 // 2


def test_shared_pairs_are_sent_as_lists(spark, monkeypatch):
    """A value of 40 items is 780 pairs; what is shuffled by item are lists, of a block's length at most."""
    monkeypatch.setattr(joins, "VALUE_ROWS", 6)
    rows = spark.range(40).selectExpr("id as k", "'all' as v").union(spark.range(0, 40, 3).selectExpr("id", "'third'"))
    pairs = joins.shared_attribute_pairs(rows, "k", "v")
    got = {(r.a, r.b): r.shared for r in pairs.collect()}
    assert got == {(a, b): 2 if a % 3 == b % 3 == 0 else 1 for a in range(40) for b in range(a + 1, 40)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(_later") < plan.index("hashpartitioning(a#") and "hashpartitioning(a#" not in plan[: plan.index("explode(_later")]
