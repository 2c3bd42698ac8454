"""The gate of whole books: measures of all books from one scan of their units, then alarms and warnings on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.gates import all_rules


@dataclass(frozen=True)
class BookLimits:
    """Limits of a gate; percentages are whole numbers, shares lie between 0 and 1."""

    # They must be these for equal verdicts.
    complete: int = 100  # per cent of chapters without a missing term
    residue: int = 0
    shells: int = 0
    shell_length: int = 10  # characters of the second script
    source_shell_length: int = 20  # characters of the trimmed text
    bilingual: int = 99  # per cent
    density: float = 0.6
    units_per_chapter: int = 15
    least_expected: int = 12
    chapter_floor: int = 6
    low_chapters: int = 2
    top_share: float = 0.95
    top_share_from: int = 20  # books of more units


def term_key(text: Column) -> Column:
    """Trimmed, lower-cased, white space as one space, without s at the end."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")), "s+$", "")


def missing_terms(units: DataFrame, outline: DataFrame) -> DataFrame:
    """(book, chapter, term): the keys of an outline's terms (book, chapter, terms) that no unit's title of the chapter has.

    Chapters and terms are compared by equality of keys, so that the join is one on hashes. Null terms ask for nothing.
    """
    asked = outline.where("book is not null and chapter is not null").select("book", "chapter", F.explode(F.array_distinct(F.transform("terms", term_key))).alias("term")).where("term is not null").distinct()
    held = units.select("book", "chapter", term_key(F.col("title")).alias("term"))
    return asked.join(held, ["book", "chapter", "term"], "left_anti")


def _measured(units: DataFrame, limits: BookLimits, residue: str, script: str, why: str, shallow: Column) -> DataFrame:
    """A row per book with units. Three groupings of one scan; what is shuffled is a row per book, chapter and kind of a task."""
    second, first = F.col("translated"), F.col("text")
    flags = {
        "bilingual": second.rlike(f"[{script}]"), "residue": second.rlike(residue), "shells": F.length(F.regexp_replace(second, f"[^{script}]", "")) < limits.shell_length,
        "source_shells": F.length(F.trim(first)) < limits.source_shell_length, "shallow": shallow}
    rows = units.where("book is not null").select("book", "chapter", "kind", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])
    cube = rows.groupingSets([["book"], ["book", "chapter"], ["book", "kind"]], "book", "chapter", "kind").agg(
        F.count("*").alias("n"), F.grouping("chapter").alias("_c"), F.grouping("kind").alias("_k"), *[F.sum(n).alias(n) for n in flags])
    whole, kind = (F.col("_c") == 1) & (F.col("_k") == 1), F.col("_k") == 0
    chapter = (F.col("_c") == 0) & (F.col("chapter") != 0)  # null and front matter are no chapters
    return cube.groupBy("book").agg(
        F.max(F.when(whole, F.col("n"))).alias("units"), *[F.max(F.when(whole, F.col(n))).alias(n) for n in flags],
        F.coalesce(F.max(F.when(kind & (F.col("kind") == why), F.col("n"))), F.lit(0)).alias("why"), F.max(F.when(kind, F.col("n"))).alias("top"),
        F.count_if(chapter).alias("chapters"), F.count_if(chapter & (F.col("n") < limits.chapter_floor)).alias("low_chapters"))


def book_gate(
    books: DataFrame, units: DataFrame, outline: DataFrame, overviews: DataFrame, residue: str, shallow: Column,
    why: str = "rationale", script: str = "一-龥", limits: BookLimits = BookLimits(),
) -> DataFrame:
    """(book, measures, alarms, warnings, verdict): a row for each of books (book), with or without units.

    units: (book, chapter, kind, title, text, translated); outline: (book, chapter, terms); overviews: (book), those that
    have one. residue: pattern of marks that must not be left in a translation; script: range of the second language's characters;
    shallow: condition on a unit. A null text or translation counts for no measure of texts, a null chapter and chapter 0
    for no chapter, a null kind as a kind of its own. Units of books that aren't in books, and null books, are left out; repeated
    books are one. Where the outline has no chapter of a book, `complete` is null and a warning says so.
    """
    missing = missing_terms(units, outline).groupBy("book").agg(F.countDistinct("chapter").alias("incomplete"), F.count("*").alias("missing"))
    asked = outline.where("chapter is not null").groupBy("book").agg(F.countDistinct("chapter").alias("outlined"))
    out = books.select("book").where("book is not null").distinct()
    out = out.join(_measured(units, limits, residue, script, why, shallow), "book", "left").join(asked, "book", "left").join(missing, "book", "left")
    out = out.join(overviews.select("book").distinct().withColumn("overview", F.lit(True)), "book", "left")
    counts = ["units", "bilingual", "residue", "shells", "source_shells", "shallow", "why", "chapters", "low_chapters", "missing"]
    per_cent = lambda part, of: F.bround(F.lit(100.0) * part / of).cast("int")
    n, expected = F.coalesce("units", F.lit(0)), F.greatest(F.lit(limits.least_expected), F.col("chapters") * limits.units_per_chapter)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).select(
        "book", *counts, F.coalesce("overview", F.lit(False)).alias("overview"), per_cent(F.col("bilingual"), F.greatest(n, F.lit(1))).alias("bilingual_share"),
        F.when(n > 0, F.col("top") / n).otherwise(1.0).alias("top_share"), (n / expected).alias("density"),
        per_cent(F.col("outlined") - F.coalesce("incomplete", F.lit(0)), F.col("outlined")).alias("complete"))
    alarms = [
        ("incomplete", F.col("complete") < limits.complete), ("residue", F.col("residue") > limits.residue), ("shells", F.col("shells") > limits.shells),
        ("source shells", F.col("source_shells") > limits.shells), ("not bilingual", F.col("bilingual_share") < limits.bilingual), ("sparse", F.col("density") < limits.density),
        ("low chapters", F.col("low_chapters") > limits.low_chapters), ("no overview", ~F.col("overview")), ("no why", (n > 0) & (F.col("why") == 0)),
        ("one kind", (F.col("top_share") > limits.top_share) & (n > limits.top_share_from))]
    warnings = [("shallow", F.col("shallow") > 0), ("completeness unknown", F.col("complete").isNull())]
    out = out.withColumn("alarms", all_rules(alarms)).withColumn("warnings", all_rules(warnings))
    return out.withColumn("verdict", F.when(F.size("alarms") == 0, "pass").otherwise("alarm"))
