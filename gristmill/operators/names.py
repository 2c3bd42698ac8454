"""Names of concepts and persons: gates that tell two names apart or hold them to be one, and names that name nobody."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.gates import first_rule

#: Words that make no difference between names.
STOP_WORDS = ("of", "the", "a", "an", "and", "to", "at", "for", "in", "on", "vs")
HAN = r"[一-鿿]"


@dataclass(frozen=True)
class Dimension:
    """A property that names state, and its values; names with other values of an essential one differ."""

    name: str
    values: Sequence[str]
    essential: bool = True

    def of(self, name: Column) -> Column:
        """The longest value that the name contains, null for none; of equally long ones the first."""
        held = F.lower(name)
        order = sorted(self.values, key=len, reverse=True)
        return F.coalesce(*[F.when(held.contains(v.lower()), F.lit(v.lower())) for v in order], F.lit(None).cast("string"))


@dataclass(frozen=True)
class Family:
    """Dimensions of the names that hold one of the words."""

    words: Sequence[str]
    dimensions: Sequence[Dimension]

    def holds(self, *names: Column) -> Column:
        out = F.lit(False)
        for name in names:
            for word in self.words:
                out = out | F.coalesce(F.lower(name).contains(word.lower()), F.lit(False))
        return out


def name_tokens(name: Column) -> Column:
    """The distinct words of a-z in a name, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def differing_dimension(a: Column, b: Column, families: Sequence[Family]) -> Column:
    """The first essential dimension in which two names have different values, in the first family that holds; else null."""
    rules = []
    for family in families:
        differ = [F.when(d.of(a) != d.of(b), F.lit(d.name)) for d in family.dimensions if d.essential]
        rules.append((family.holds(a, b), F.coalesce(*differ, F.lit(None).cast("string"))))
    out = F.lit(None).cast("string")
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def subsumed(a: Column, b: Column) -> Column:
    """Whether one name has all words of the other and more, or, where one has Han characters, contains the other."""
    s, t = name_tokens(a), name_tokens(b)
    inside = (F.size(s) > 0) & (F.size(t) > 0) & (F.size(s) != F.size(t)) & ((F.size(F.array_except(s, t)) == 0) | (F.size(F.array_except(t, s)) == 0))
    x, y = [F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "") for c in (a, b)]
    part = F.concat(x, y).rlike(HAN) & (x != y) & (x != "") & (y != "") & (x.contains(y) | y.contains(x))
    return inside | part


def gated(pairs: DataFrame, a: str, b: str, families: Sequence[Family], terms: DataFrame) -> DataFrame:
    """pairs with verdict ('different', 'same' or null) and gate ('dimension', 'subset', 'canonical' or null).

    The gates that tell names apart come before that which holds them to be one: a needless split costs
    less than a wrong merge. terms: (name, canonical) of a controlled vocabulary, a row a name; names are
    compared trimmed and in lower case. It is joined on the names, so that it may have any size. Where neither gate
    speaks, verdict is null and the pair is for a judge. A null name is in no family and has no term.
    """
    keyed = terms.select(F.lower(F.trim("name")).alias("_k"), F.col("canonical").alias("_t")).where("_k is not null").groupBy("_k").agg(F.min("_t").alias("_t"))
    out = pairs
    for i, c in enumerate((a, b)):
        side = keyed.select(F.col("_k").alias(f"_k{i}"), F.col("_t").alias(f"_t{i}"))
        out = out.withColumn(f"_k{i}", F.lower(F.trim(c))).join(side, f"_k{i}", "left")
    gate = F.when(differing_dimension(F.col(a), F.col(b), families).isNotNull(), "dimension").when(subsumed(F.col(a), F.col(b)), "subset").when(F.col("_t0") == F.col("_t1"), "canonical")
    out = out.withColumn("gate", gate)
    verdict = F.when(F.col("gate").isin("dimension", "subset"), "different").when(F.col("gate") == "canonical", "same")
    return out.withColumn("verdict", verdict).drop("_k0", "_k1", "_t0", "_t1")


def generic_reason(name: Column, words: Sequence[str], signs: Sequence[str], suffixes: Sequence[str], people: str, clans: Sequence[str], variants: Mapping[str, str] | None = None) -> Column:
    """Why a name names no single person, null if it may: 'empty', 'single', 'word', 'signs', 'office', 'people' or 'clan', the first that holds.

    words: whole names that stand for anybody; signs: characters of which a name must not consist alone;
    suffixes: last characters of offices and troops, in names of up to three characters; people: the
    last of two characters of which the first is one of the signs; clans: endings of houses. variants maps characters to
    the written form of the lists, before all else.
    """
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s", "")
    if variants:
        bare = F.translate(bare, "".join(variants), "".join(variants.values()))
    only = F.forall(F.split(bare, ""), lambda x: x.isin(*signs))
    last, size = F.right(bare, F.lit(1)), F.length(bare)
    house = F.lit(False)
    for ending in clans:
        house = house | bare.endswith(ending)
    rules = [
        ("empty", bare == ""), ("single", size == 1), ("word", bare.isin(*words)), ("signs", only), ("office", (size <= 3) & last.isin(*suffixes)),
        ("people", (size == 2) & (last == people) & F.left(bare, F.lit(1)).isin(*signs)), ("clan", house)]
    return F.nullif(first_rule(rules, ""), F.lit(""))
