"""Gates of whole books, readers' tools and files on small cases, by hand or against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gristmill.operators import answers, books, lines
from gristmill.sources import files

UNIT = "book string, chapter int, kind string, title string, text string, translated string, extra int"


def key(text):
    return re.sub("s+$", "", re.sub(r"\s+", " ", text.strip().lower()))


def by_hand(name, units, outline, seen, limits):
    rows = [u for u in units if u[0] == name]
    n, kinds = len(rows), Counter(u[2] for u in rows)
    per_chapter = Counter(u[1] for u in rows if u[1])
    asked = {}
    for b, c, terms in outline:
        if b == name and c is not None:
            asked.setdefault(c, set()).update(key(t) for t in terms or [] if t is not None)
    gaps = {c: terms - {key(u[3]) for u in rows if u[1] == c and u[3] is not None} for c, terms in asked.items()}
    whole = round(100 * sum(not g for g in gaps.values()) / len(gaps)) if gaps else None
    found = {
        "residue": sum("##" in (u[5] or "") for u in rows), "shells": sum(u[5] is not None and len(re.sub("[^a-z]", "", u[5])) < limits.shell_length for u in rows),
        "source_shells": sum(u[4] is not None and len(u[4].strip(" ")) < limits.source_shell_length for u in rows), "bilingual": sum(bool(re.search("[a-z]", u[5] or "")) for u in rows),
        "shallow": sum(u[4] is not None and "why" not in u[4] for u in rows), "low": sum(v < limits.chapter_floor for v in per_chapter.values())}
    share, density = round(100 * found["bilingual"] / max(n, 1)), n / max(limits.least_expected, len(per_chapter) * limits.units_per_chapter)
    top = max(kinds.values(), default=0) / n if n else 1.0
    alarms = [a for a, holds in [
        ("incomplete", whole is not None and whole < 100), ("residue", found["residue"] > 0), ("shells", found["shells"] > 0), ("source shells", found["source_shells"] > 0), ("not bilingual", share < 99),
        ("sparse", density < limits.density), ("low chapters", found["low"] > limits.low_chapters), ("no overview", name not in seen), ("no why", n > 0 and kinds["rationale"] == 0),
        ("one kind", top > limits.top_share and n > limits.top_share_from)] if holds]
    warnings = [w for w, holds in [("shallow", found["shallow"] > 0), ("completeness unknown", whole is None)] if holds]
    return n, whole, sum(map(len, gaps.values())), len(per_chapter), alarms, warnings, "alarm" if alarms else "pass"


def test_book_gate(spark):
    rng, limits = random.Random(3), books.BookLimits()
    units = [
        (rng.choice("abc"), rng.choice([None, 0, 1, 2, 3]), rng.choice(["rationale", "fact", None]), rng.choice(["Costs ", "cost", "The  Price", None, ""]),
         rng.choice(["why prices rise in the long run", "short", None, "   padded by spaces         "]), rng.choice(["abcdefghijklmn", "abc", "## abcdefghijklmn", None, ""]), 1)
        for _ in range(160)]
    units += [("whole", 1 + i % 2, "rationale" if i % 3 else "fact", f"Term {i}", "why it is so, told at length", "all of the second script", 1) for i in range(40)]
    units += [("single", 1, "fact", "x", "why it is so, told at length", "all of the second script", 1) for _ in range(21)] + [(None, 1, "fact", "x", "y", "z", 1)]
    outline = [("a", 1, ["Cost", "prices"]), ("a", 1, ["COSTS", None]), ("a", 9, ["gone"]), ("b", 2, None), ("b", 3, []), ("whole", 1, ["term 2", "Term 4"]), ("whole", 2, ["term 1"]), ("empty", 1, ["z"]), ("c", None, ["x"]), (None, 1, ["x"])]
    seen = {"a", "whole"}
    names = ["a", "b", "c", "whole", "single", "empty", "blank"]
    shelf = spark.createDataFrame([(n,) for n in [*names, "a", None]], "book string")
    u, o = spark.createDataFrame(units, UNIT), spark.createDataFrame(outline, "book string, chapter int, terms array<string>")
    v = spark.createDataFrame([("a",), ("a",), ("whole",), (None,)], "book string")
    got = {r["book"]: r for r in books.book_gate(shelf, u, o, v, "##", ~F.col("text").contains("why"), script="a-z").collect()}
    assert sorted(got) == sorted(names)
    for n in names:
        r = got[n]
        assert (r["units"], r["complete"], r["missing"], r["chapters"], r["alarms"], r["warnings"], r["verdict"]) == by_hand(n, units, outline, seen, limits), n
    assert got["whole"]["verdict"] == "pass" and got["single"]["alarms"][-1] == "one kind" and got["blank"]["top_share"] == 1.0
    assert {(r["book"], r["chapter"], r["term"]) for r in books.missing_terms(u, o).collect()} >= {("a", 9, "gone"), ("empty", 1, "z")}
    assert books.book_gate(shelf.limit(0), u.limit(0), o.limit(0), v.limit(0), "##", F.lit(False)).count() == 0


def test_answers(spark):
    rows = spark.createDataFrame([(1, 7, "a", None), (2, 7, "b", "gone"), (3, 8, "c", None), (None, 7, "d", None)], "id int, owner int, name string, deleted string")
    asked = spark.createDataFrame([(0, 1, 7), (1, 1, 8), (2, 2, 7), (3, 9, 7), (4, None, 7), (5, 3, 8), (6, 3, None), (7, 1, 7)], "n int, id int, owner int")
    got = answers.fetched(asked, rows, "id", "owner", {"name_found": F.col("name")}, F.col("deleted").isNotNull())
    assert {r["n"]: (r["name_found"], r["error"]) for r in got.collect()} == {0: ("a", None), 5: ("c", None), 7: ("a", None), **{n: (None, "Not found") for n in (1, 2, 3, 4, 6)}}
    log = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(1, 60)], "seq int, owner int")
    cursors = spark.createDataFrame([(0, 20), (0, 30), (1, 100), (None, 1)], "owner int, since int")
    next_ = answers.changes_since(log, cursors, "owner", "seq", 4).collect()
    assert sorted((r["owner"], r["at"], r["seq"]) for r in next_) == [(0, 1, 33), (0, 2, 36), (0, 3, 39), (0, 4, 42), (2, 1, 2), (2, 2, 5), (2, 3, 8), (2, 4, 11)]
    assert [r["seq"] for r in answers.recent(log.where("owner = 1"), "owner", [F.col("seq").desc()], 2, F.col("seq") == 58).orderBy("at").collect()] == [55, 52]
    assert answers.recent(log.limit(0), "owner", [F.col("seq")], 2).count() == 0


def test_needs_and_shelves(spark, tmp_path):
    rows = spark.createDataFrame([(" rain ", "miss", ["a", " b ", "", None, *map(str, range(9))]), ("", None, ["c"]), (None, "x", None)], "topic string, reason string, subtopics array<string>")
    files.export_json(rows, str(tmp_path / "n"))
    got = sorted((r["topic"], r["reason"]) for r in files.needs(spark, str(tmp_path / "n")).collect())
    assert got == sorted([("rain", "miss"), ("c", "subtopic of "), *[(t, "subtopic of  rain ") for t in ["a", "b", "0", "1", "2", "3", "4", "5"]]])
    texts = spark.createDataFrame([(i // 3, i, None if i == 4 else f"line {i}") for i in range(9)], "shelf int, i int, t string")
    files.shelved(texts, "shelf", "i", "t", str(tmp_path / "s"))
    read = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "s"), wholetext=True)
    found = {r["path"].split("shelf=")[1][0]: r["value"] for r in read.select("value", F.col("_metadata.file_path").alias("path")).collect()}
    assert found == {"0": "line 0\nline 1\nline 2\n", "1": "line 3\n\nline 5\n", "2": "line 6\nline 7\nline 8\n"}


def test_running_lines(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["page head", "abcd", "other line", "x" * 251, "", "text that is long"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", None, "page head\n" * 3]
    got = {r["i"]: (r["t"], r["dropped"]) for r in lines.without_repeated(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", 3).collect()}
    for i, t in enumerate(texts):
        if t is not None:
            n = Counter(t.split("\n"))
            kept = [x for x in t.split("\n") if not (5 <= len(x) <= 250 and n[x] >= 3)]
            assert got[i] == ("\n".join(kept), len(t.split("\n")) - len(kept)), i
