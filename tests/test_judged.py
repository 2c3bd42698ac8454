"""Gates, names, re-ingest, needs and chains on small cases, by hand or against plain Python."""

import random
import re

from pyspark.sql import functions as F

from gristmill.operators import gates, graph, names, rework

FAMILIES = [
    names.Family(["elasticity"], [names.Dimension("of", ["price", "cross-price", "income"]), names.Dimension("wording", ["own", "simple"], essential=False)]),
    names.Family(["cost"], [names.Dimension("run", ["long-run", "short-run"])]),
]
PAIRS = [
    ("Price Elasticity", "Income Elasticity", "dimension"), ("Price elasticity", "Cross-Price Elasticity", "dimension"), ("own elasticity", "simple elasticity", None),
    ("Long-run cost", "Short-run cost", "dimension"), ("Long-run plan", "Short-run plan", None), ("Opportunity Cost", "Production Opportunity Cost", "subset"),
    ("The theory of games", "Theory games", None), ("机会成本", "生产机会成本", "subset"), ("机会 成本", "机会成本", None), ("GDP", "Gross Domestic Product", "canonical"),
    ("GDP ", "gdp", "canonical"), ("Gross product", "Gross Domestic Product", "subset"), (None, "GDP", None), (None, None, None), ("", "x", None), ("the", "the of", None), ("same", "same", None)]


def test_gates_on_names(spark):
    rows = spark.createDataFrame([(i, a, b, "kept") for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string, _t string")
    terms = spark.createDataFrame([("GDP", "gdp"), ("gross domestic product", "gdp"), ("Gross product", "gdp"), ("gdp ", "gdp"), (None, "none"), ("same", None)], "name string, canonical string")
    got = {r["i"]: r for r in names.gated(rows, "a", "b", FAMILIES, terms).collect()}
    for i, (a, b, gate) in enumerate(PAIRS):
        assert got[i]["gate"] == gate, (a, b)
        assert got[i]["verdict"] == {"dimension": "different", "subset": "different", "canonical": "same"}.get(gate)
        assert got[i]["_t"] == "kept"
    assert names.gated(rows.limit(0), "a", "b", FAMILIES, terms.limit(0)).count() == 0


def test_names_of_nobody(spark):
    cases = [("", "empty"), (None, "empty"), ("王", "single"), ("太 子", "word"), ("夷狄", "signs"), ("巴師", "office"), ("戎人", "people"), ("张人", None), ("姬氏", "clan"), ("管仲", None), ("巴师", "office"), ("大巴山師", None)]
    rows = spark.createDataFrame([(n, w) for n, w in cases], "n string, w string")
    reason = names.generic_reason(F.col("n"), ["太子"], ["夷", "狄", "戎"], ["師"], "人", ["氏"], {"师": "師"})
    assert [(r["n"], r["got"]) for r in rows.select("n", reason.alias("got")).collect()] == cases


def accepted(md, expected):
    numbers = [int(x) for x in re.findall(r"^# Chapter (\d+):", md, re.M)]
    at = [m.start() for m in re.finditer(r"^# Chapter \d+:", md, re.M)] + [len(md)]
    largest = round(max((b - a for a, b in zip(at, at[1:])), default=0) / max(len(md), 1) * 100, 1)
    noise = len(re.findall(r"C\s+H\s+A\s+P\s+T\s+E\s+R\s+\d", md))
    right = numbers == list(range(1, len(numbers) + 1))
    return len(numbers), right, len(numbers) == expected, largest, noise, len(re.findall(r"\|[^\n]*<br>[^\n]*\|", md)), right and len(numbers) == expected and largest < 40 and noise <= 2


def test_acceptance_of_books(spark):
    rng, parts = random.Random(5), ["# Chapter 1:", "# Chapter 2: b", "# Chapter 3: c", "text # Chapter 9:", "| a <br> b |", "C H A P T E R 4", "x" * 30, "", "## Chapter 2:", "# Chapter 12345678901234567890:"]
    books = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(60)]
    books += ["", "intro\n" + "\n".join(f"# Chapter {i}: t\n{'y' * 40}" for i in range(1, 6)), "\n".join(f"# Chapter {i}: t\n{'y' * 40}" for i in range(1, 6)) + "\nC H A P T E R 1" * 3]
    rows = spark.createDataFrame([(i, t, rng.choice([3, 5]) if i < 60 else 5) for i, t in enumerate(books)] + [(99, None, 0), (100, "a", None)], "i int, t string, n int")
    got = {r["i"]: tuple(r["x"]) for r in rows.select("i", gates.acceptance(F.col("t"), F.col("n")).alias("x")).collect()}
    wanted = {r["i"]: r["n"] for r in rows.collect()}
    for i, t in enumerate(books):
        assert got[i] == accepted(t, wanted[i]), t
    assert got[99] == (0, True, True, 0.0, 0, 0, True) and got[100][2] is False and any(got[i][-1] for i in range(63))


def test_measured_gate(spark):
    rows = spark.createDataFrame([("a", True, ["x"], None), ("a", None, None, None), ("a", True, ["y"], ["y"]), ("b", True, ["lim"], ["x"]), (None, False, [], None)], "k string, m boolean, issues array<string>, exempt array<string>")
    units = rows.withColumn("open", gates.open_issues(F.col("issues"), F.col("exempt"), ["lim"]))
    out = gates.measured_gate(units, ["k"], {"n": F.count("*"), "match": gates.share_of(F.col("m")), "open": gates.share_of(F.size("open") > 0), "none": F.max(F.lit(None).cast("int"))}, [("few", F.col("n") < 2), ("open", F.col("open") > 0.3), ("null", F.col("none") > 0)], [("match", F.col("match") < 0.9)])
    got = {r["k"]: (r["n"], round(r["match"], 3), round(r["open"], 3), r["alarms"], r["warnings"], r["ok"]) for r in out.collect()}
    assert got == {"a": (3, 0.667, 0.333, ["open"], ["match"], False), "b": (1, 1.0, 0.0, ["few"], [], False), None: (1, 0.0, 0.0, ["few"], ["match"], False)}
    assert gates.measured_gate(units.limit(0), ["k"], {"n": F.count("*")}, []).count() == 0


def test_sources_read_again(spark):
    units = spark.createDataFrame([(1, "s", "A", None, None, "x"), (2, "s", "B", "old", 9, "x"), (3, "t", "A", None, None, "x"), (4, None, "C", None, None, "x")], "unit_id int, source string, grade string, valid_until string, superseded_by int, _again string")
    units = units.withColumnRenamed("_again", "again")
    ingested = spark.createDataFrame([("s", 1), ("t", 2), (None, 3)], "source string, at int")
    again = spark.createDataFrame([("s",), ("s",), ("u",), (None,)], "source string")
    after, history, left = rework.reingested(units, ingested, again, "why", F.lit("now"))
    assert sorted((r["unit_id"], r["valid_until"], r["superseded_by"], r["again"]) for r in after.collect()) == [(1, "now", None, "x"), (2, "old", 9, "x"), (3, None, None, "x"), (4, None, None, "x")]
    assert [tuple(r) for r in history.collect()] == [(1, "A", "A", "reingest: why")]
    assert sorted((r["at"], r["source"]) for r in left.collect()) == [(2, "t"), (3, None)]
    twice = rework.reingested(after, left, again, "why", F.lit("later"))  # nothing is current any more
    assert twice[1].count() == 0 and sorted(map(str, twice[0].collect())) == sorted(map(str, after.collect()))


def test_needs_keep_or_replace_directions(spark):
    missed = spark.createDataFrame([("red gear", 2), ("blue", 9), ("red", None), (None, 1), ("gear gear", 5)], "topic string, miss_count int")
    first = spark.createDataFrame([(2, "b"), (1, "a")], "at int, topic string")
    old = rework.merged_needs(first.selectExpr("0 as part", "at", "topic").limit(0), first, missed)
    assert [r["topic"] for r in old.collect()][:2] == ["a", "b"] and all(r["purpose_score"] is None for r in old.collect())
    kept = rework.merged_needs(old, None, missed, "Red, gear!")
    assert [(r["part"], r["topic"], r["purpose_score"]) for r in kept.collect()] == [(0, "a", None), (0, "b", None), (1, "gear gear", 1.0), (1, "red gear", 1.0), (1, "red", 1.0), (1, "blue", 0.0), (1, None, 0.0)]
    gone = rework.merged_needs(old, first.limit(0), missed.limit(2), "gear")
    assert [(r["part"], r["topic"], r["purpose_score"]) for r in gone.collect()] == [(1, "red gear", 0.5), (1, "blue", 0.0)]


def chains(edges):
    near = {}
    for s, d in edges:
        near.setdefault(s, set()).add(d)
    into = {d for _, d in edges}
    starts = {s for s, _ in edges} - into or {min(x for e in edges for x in e)}
    out, stack = set(), [(s,) for s in starts]
    while stack:
        path = stack.pop()
        if path[-1] in path[:-1] or path[-1] not in near:
            out.add(path)
        else:
            stack += [path + (d,) for d in near[path[-1]]]
    return sorted(p for p in out if len(p) >= 3)


def test_all_chains(spark):
    rng = random.Random(8)
    cases = [[(i, i + 1) for i in range(1, 9)], [(1, 2), (2, 3), (3, 2), (3, 4)], [(1, 2), (2, 3), (3, 1)], [(1, 1)], [(1, 2)], [(5, 5), (4, 5), (5, 6)]]
    cases += [sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(9)}) for _ in range(3)]
    for edges in cases:
        rows = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "src int, dst int")
        assert sorted(tuple(r["path"]) for r in graph.all_chains(rows).collect()) == chains(edges), edges
    assert graph.all_chains(spark.createDataFrame([], "src int, dst int")).count() == 0
