"""Typed queries against plain Python, and the recall of indexed vector joins."""

import collections
import math
import random
import re

import pytest

from gristmill.operators import ivf, joins, search

DATA = "/root/testdata/sf0.01"


def plain_tokens(t):
    return re.findall("[a-z0-9]+|[一-鿿]", (t or "").lower())


def plain_search(docs, typed):
    """{id: score} of one query: alternatives of items, each item a list of words that follow one another."""
    alternatives, part = [[]], re.findall(r'-?"[^"]*"?|\S+', typed)
    for p in part:
        if p.lower() == "or":
            alternatives.append([])
        elif plain_tokens(p):
            alternatives[-1].append((p.startswith("-"), plain_tokens(p)))
    words = {i: plain_tokens(t) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for items in alternatives:
        starts = [{i: s for i, w in words.items() if (s := [k for k in range(len(w)) if w[k : k + len(x)] == x])} for _, x in items]
        must = [s for (out_, _), s in zip(items, starts, strict=True) if not out_]
        for i, w in words.items():
            if not must or any(i not in s for s in must) or any(i in s for (no, _), s in zip(items, starts, strict=True) if no):
                continue
            score = 0.0
            for s in must:
                tf, d = len(s[i]), len(s)
                score += math.log(1 + (len(words) - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if len(must) > 1:
                covers = [e - min(max((p for p in s[i] if p <= e), default=-math.inf) for s in must) + 1 for s2 in must for e in s2[i]]
                score += len(must) / min(covers)
            out[i] = max(out.get(i, -1), round(score, 6))
    return out


TYPED = ['alpha beta', '"alpha beta"', '"beta alpha beta"', "alpha OR gamma", "alpha -beta", '-"alpha beta" gamma', '"alpha beta" gamma OR delta -alpha', "state-of-art", "学习 alpha", '"', "-alpha", "nothing", "or or", "alpha alpha", None]


def test_typed_queries(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "delta", "state of-art", "学习", "习学", "x", "y", "z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(150)] + [(900, None), (901, ""), (902, "alpha " * 3000 + "beta"), (903, "q" * 500)]
    index = search.build(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text")
    asked = spark.createDataFrame(list(enumerate(TYPED)), "q int, typed string")
    got = collections.defaultdict(dict)
    for r in search.search(index, asked, "q", "typed", 1000).collect():
        got[r.q][r.id] = r.score
    for q, typed in enumerate(TYPED):
        want = plain_search(docs, typed or "")
        assert got[q].keys() == want.keys(), typed
        assert all(abs(got[q][i] - want[i]) < 2e-6 for i in want), typed
    assert max(r.rank for r in search.search(index, asked, "q", "typed", 3).collect()) == 3
    assert search.search(search.build(spark.createDataFrame([], "id long, text string"), "id", "text"), asked, "q", "typed", 3).count() == 0


def test_a_batch_reads_only_its_own_folders(spark):
    index = search.build(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text")
    items = search.parsed(spark.createDataFrame([(1, "the thing")], "q int, typed string"), "q", "typed")
    plan = search.occurrences(index, items)._jdf.queryExecution().toString()
    assert "PartitionFilters: [_folder" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("k, group", [(4, None), (3, "label")])
def test_indexed_neighbours(spark, k, group):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    lists = ivf.build(rows, "vec_id", "embedding", "label")
    assert lists.rows.count() == rows.count()  # every row is indexed
    exact = {(r.q, r.n, r.sim) for r in joins.knn(rows, rows, "vec_id", "embedding", k, group).collect()}
    got = [tuple(r)[:3] for r in ivf.knn(lists, rows, k, ivf.probes_for(lists, k, group=group), group).collect()]
    assert len(got) == len(set(got)) and len(exact & set(got)) >= 0.9 * len(exact)


def test_indexed_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    lists = ivf.build(rows, "vec_id", "embedding")
    probes = ivf.probes_for(lists, least=0.4, recall=0.8)
    exact = {tuple(r) for r in joins.similar_pairs(rows, "vec_id", "embedding", 0.4).collect()}
    got = {tuple(r) for r in ivf.similar_pairs(lists, 0.4, probes).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)
    assert ivf.probed(lists, probes) < 0.4 * rows.count() ** 2


def test_clustered_vectors_need_few_probes(spark):
    """Vectors in 40 clusters: work falls with the number of lists."""
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = spark.createDataFrame([(i, [x + rng.gauss(0, 0.15) for x in centres[i % 40]]) for i in range(4000)] + [(9000, None), (9001, [1.0, None]), (9002, [1.0])], "id long, v array<double>")
    lists = ivf.build(rows, "id", "v")
    probes = ivf.probes_for(lists, 5)
    exact = {(r.q, r.n) for r in joins.knn(rows, rows, "id", "v", 5).collect()}
    got = {(r.q, r.n) for r in ivf.knn(lists, rows, 5, probes).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and ivf.probed(lists, probes) < 0.25 * 4000**2
