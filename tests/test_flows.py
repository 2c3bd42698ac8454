"""Streams with books and sinks, chapters, and graph searches by levels against plain Python."""

import collections
import datetime
import random

import pytest

from gristmill.functions import chapters
from gristmill.operators import graph
from gristmill.plans.flows import _links
from gristmill.sources import feeds
from gristmill.sources.files import shared_folder
from gristmill.streaming import ingest, ledger
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_ledger_like_a_loop(spark):
    """Days, months, rotation and overflow over five ticks, one of them run again."""
    quota = ledger.Quota(("a", "b", "c"), 3, 11, 24)
    rng, served, queues = random.Random(4), [], []
    days = [datetime.date(2024, 1, 30), datetime.date(2024, 1, 30), datetime.date(2024, 1, 31), datetime.date(2024, 1, 31), datetime.date(2024, 2, 1)]
    for t, day in enumerate(days):
        queue = [(f"t{i}", "abcx"[i % 4] if i % 7 else "a", i) for i in sorted(rng.sample(range(30), 18))]
        queues.append([(*q, day) for q in queue])
        last = {topic: tick for topic, *_, tick in served}
        month = lambda: sum(d.month == day.month for _, _, d, _, _ in served)  # noqa: B023, E731
        turn = lambda q: (last.get(q[0]) is not None, last.get(q[0], 0), q[2])  # noqa: B023, E731
        done, full = set(), False
        for b in quota.buckets:
            for q in sorted((q for q in queue if q[1] == b), key=turn):
                full = full or month() >= quota.month
                if full or sum(d == day and x == b for _, x, d, _, _ in served) >= quota.own:
                    break
                served.append((q[0], b, day, "own", t))
                done.add(q[0])
        rest = [q for b in quota.buckets for q in sorted((q for q in queue if q[1] == b), key=turn) if q[0] not in done]
        for q in sorted(rest, key=lambda q: turn(q)[:2]) if not full else ():
            if sum(d == day for _, _, d, _, _ in served) >= quota.day or month() >= quota.month:
                break
            served.append((q[0], q[1], day, "overflow", t))
    frames = [spark.createDataFrame(q, "topic string, bucket string, pos int, day date") for q in queues]
    got = ledger.run(frames, quota)
    assert sorted((r.topic, r.bucket, r.day, r.slot, r.tick) for r in got.collect()) == sorted(served)
    folder = shared_folder(spark)
    for t in (0, 1, 1, 2, 3, 4, 4):
        ledger.tick(frames[t], t, folder, quota)
    assert sorted((r.topic, r.bucket, r.day, r.slot, r.tick) for r in ledger.served(spark, folder).collect()) == sorted(served)


def test_a_replayed_batch_changes_nothing(spark):
    rules = ingest.Rules(lambda t: F.length(t) < 5, ("fact", "rule"))
    schema = "unit_id long, text string, kind string, tag string, discipline string"
    first = spark.createDataFrame([(1, "some text", "fact", "x", None), (2, "some text", "rule", "x", "math"), (3, "tiny", "fact", "x", "no"), (4, "other text", "tale", "y", "no"), (5, None, "fact", None, None), (6, "lone text", None, "y", None)], schema)
    second = spark.createDataFrame([(7, "some text", "fact", "z", "law"), (8, "fresh text", "rule", "x", "econ"), (9, "more text", "fact", "x", "math"), (10, "last text", "tale", None, None)], schema)
    folder = shared_folder(spark)

    def state():
        return {n: sorted(map(str, ingest.sink(spark, folder, n).collect())) for n in ingest.SINKS} | {"t": sorted(map(tuple, ingest.tags(spark, folder).collect()))}

    ingest.persist(first, 0, folder, rules)
    ingest.persist(second, 1, folder, rules)
    once = state()
    for batch in (1, 0, 1, 1):
        ingest.persist((first, second)[batch], batch, folder, rules)
    assert state() == once and once["t"] == [("x", "econ", 3)]
    ids = lambda n: sorted(r.unit_id for r in ingest.sink(spark, folder, n).collect())
    assert (ids("units"), ids("merges"), ids("rejects"), ids("audit")) == ([1, 8, 9], [2, 7], [3, 4, 5, 6, 10], [1, 8, 9])
    assert sorted(map(tuple, ingest.lessons(spark, folder).collect())) == [("vocabulary", "", 1, 6), ("vocabulary", "tale", 2, 4)]


def test_feed_source_goes_on_from_its_offset(spark):
    folder = shared_folder(spark)
    rows = spark.createDataFrame([("a", "One"), ("b", None), (None, "no key")], "k string, t string")

    def tick():
        s = feeds.item_stream(spark, f"{folder}/feed", "news")
        s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.external_id, r.title, r.delivery) for r in spark.read.schema(feeds.SCHEMA).parquet(f"{folder}/out").collect())

    feeds.deliver(rows, f"{folder}/feed", 1, "k", "t")
    assert tick() == [("a", "One", "000001"), ("b", None, "000001")] == tick()
    feeds.deliver(rows.where("k = 'a'"), f"{folder}/feed", 2, "k", "t")
    assert tick()[1] == ("a", "One", "000002") and len(tick()) == 3
    assert feeds.items(spark, f"{folder}/feed", "news").count() == 3 and feeds.items(spark, f"{folder}/none", "news").count() == 0


BOOK = "# Chapter {}: Title\n" + "words " * 400 + "\n"


@pytest.mark.parametrize(("text", "numbers"), [
    ("Contents\nChapter 1\nChapter 2\nChapter 3\n\n" + "".join(BOOK.format(i) for i in (1, 2, 3)), [1, 2, 3]),
    ("Chapter 3 is a good example.\n" + "".join(BOOK.format(i) for i in (1, 2, 3)), [1, 2, 3]),
    ("Chapter 1 .... 7\n" + "".join(BOOK.format(i) for i in (1, 2)), [1, 2]),
    ("第一章 起\n第二章 承\n" + "".join(f"第{n}章 x\n" + "字" * 2000 + "\n" for n in ("一", "二", "十", "二十一", "一百零三")), [1, 2, 10, 21, 103]),
    ("## 1.2 Later\ntext\n## 1.1 First\ntext\n## 2.1 Next\ntext", [1, 2]),
    ("\n\n1.1 Finding Words\n\nAs section 1.2 says.\n\n2.1 More Of It\n\nx", [1, 2]),
    (BOOK.format(2) + BOOK.format(1) + BOOK.format(3), [1, 3]),
    ("no chapters 1.1 here", []), ("", []), (None, []),
])
def test_chapters(text, numbers):
    """Contents pages, mentions out of order, Han numerals and the fall-back to sections; slices follow one another."""
    got = chapters.spans(text)
    assert [n for n, _, _ in got] == numbers
    assert all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and all(s < e for _, s, e in got)
    if got and text.startswith(("Contents", "Chapter")):
        assert text[got[0][1] :].startswith("# Chapter 1: Title")


def test_chapters_end_before_the_index_and_as_a_table_function(spark):
    text = BOOK.format(1) + BOOK.format(2) + "## Index\nwords 1, 2"
    rows = chapters.chapters(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string"), "t").collect()
    assert [(r.id, r.number, text[r.end :][:8]) for r in rows] == [(1, 1, "# Chapte"), (1, 2, "## Index")]


def whole(links, labels):
    """Whether each community hangs together."""
    near = collections.defaultdict(set)
    for a, b, _ in links:
        if labels[a] == labels[b]:
            near[a].add(b), near[b].add(a)
    for c in set(labels.values()):
        members = {i for i, x in labels.items() if x == c}
        seen, todo = set(), [next(iter(members))]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += near[i] & members
        if seen != members:
            return False
    return True


def test_leiden(spark):
    """Every community is connected, and no less modular than those of the plain greedy search; cliques in a ring are found."""
    links = _links(spark, DATA)
    rows = [tuple(r) for r in links.collect()]
    both = links.unionByName(links.selectExpr("b as a", "a as b", "w"))
    one, two = (f(links) for f in (graph.leiden, graph.modular_communities))
    labels = {r.id: r.community for r in one.collect()}
    assert whole(rows, labels) and labels.keys() == {x for a, b, _ in rows for x in (a, b)}
    value = [graph.modularity(both, x.withColumnRenamed("community", "label")) for x in (one, two)]
    assert value[0] >= value[1] - 1e-9
    ring = [(5 * c + i, 5 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i)] + [(5 * c, 5 * ((c + 1) % 8) + 1, 1.0) for c in range(8)]
    found = graph.leiden(spark.createDataFrame(ring, "a long, b long, w double")).collect()
    assert len({r.community for r in found}) == 8 and all(r.community == r.id // 5 * 5 for r in found)


def test_betweenness_by_levels(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(100, 101), (101, 102), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = {r.id: r.betweenness for r in graph.betweenness(df).collect()}
    for states in (20_000_000, 700):
        got = {r.id: r.betweenness for r in graph.betweenness_by_levels(df, states).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-4 for i in want)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 5)
    assert {r.id for r in graph.betweenness(df).collect()} == want.keys()
