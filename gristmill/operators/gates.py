"""Quality gates: ordered rules, of which the first that holds names the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def first_rule(rules: Sequence[Rule], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def all_rules(rules: Sequence[Rule]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))


def ingest_gate(text: Column, status: Column, respected: Sequence[str], least: int = 500) -> Column:
    """corrupt, a respected status, fragment, empty, short or ok, in this order."""
    corrupt = F.regexp_count(text, F.lit("�")) * 20 > F.length(text)
    fragment = ~text.rlike(r"[.!?。！？]\s*$") & (F.length(text) < 2 * least) & text.rlike(r"^[a-z]")
    return F.when(corrupt, "corrupt").when(status.isin(*respected), status).when(fragment, "fragment").when(F.trim(text) == "", "empty").when(F.length(text) < least, "short").otherwise("ok")


def contiguous(numbers: Column) -> Column:
    """Whether the numbers are 1 to n, each once."""
    return (F.size(numbers) > 0) & (F.sort_array(numbers) == F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1))))


def chapter_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#* ?Chapter (\d+)"), F.lit(1)), lambda x: x.cast("int"))


def fidelity(spans: Column, signals: Column, good: float = 0.5, poor: float = 0.1) -> Column:
    """skip without signals, else good, fair or poor by spans per signal."""
    return F.when(signals == 0, "skip").when(spans >= signals * good, "good").when(spans >= signals * poor, "fair").otherwise("poor")


def acceptance(text: Column, expected: Column, share: float = 40.0, noise: int = 2) -> Column:
    """(chapters, sequential, complete, largest, noise, broken_rows, accepted) of a book as a struct.

    Chapters are lines that begin with `# Chapter n:`; sequential: their numbers are 1, 2, ... in this order;
    complete: there are as many as expected; largest: the percentage of all characters that the
    largest chapter spans, to one decimal; noise: running heads with spaced letters; broken_rows: table rows
    with line breaks inside. A book is accepted if it is sequential and complete, no chapter spans `share` percent
    and noise is not above its limit. A book without chapters is sequential, and its largest is 0. A null text is empty.
    """
    t = F.coalesce(text, F.lit(""))
    pieces = F.filter(F.split(t, r"(?md)^(?=# Chapter \d+:)"), lambda x: x.rlike(r"^# Chapter \d+:"))
    numbers = F.transform(pieces, lambda x: F.regexp_extract(x, r"^# Chapter (\d+):", 1).cast("decimal(38,0)"))
    n = F.size(pieces)
    steps = F.forall(F.zip_with(numbers, F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda x, i: x == i), lambda x: F.coalesce(x, F.lit(False)))
    longest = F.coalesce(F.array_max(F.transform(pieces, F.length)), F.lit(0))
    largest = F.round(longest / F.greatest(F.length(t), F.lit(1)) * 100 * 10) / 10  # as a double: a round to one decimal would go by its printed digits, which lie below 1.85 for 37 of 2,000
    heads = F.regexp_count(t, F.lit(r"C\s+H\s+A\s+P\s+T\s+E\s+R\s+\d"))
    rows = F.regexp_count(t, F.lit(r"\|[^\n]*<br>[^\n]*\|"))
    whole = F.coalesce(n == expected, F.lit(False))
    return F.struct(
        n.alias("chapters"), steps.alias("sequential"), whole.alias("complete"), largest.alias("largest"), heads.alias("noise"), rows.alias("broken_rows"),
        (steps & whole & (largest < share) & (heads <= noise)).alias("accepted"))


def open_issues(issues: Column, exempt: Column, limited: Sequence[str]) -> Column:
    """The issues of a unit that neither its own exemptions nor the limits of its source excuse; nulls are empty lists."""
    none = F.array().cast("array<string>")
    return F.array_except(F.coalesce(issues, none), F.array_union(F.coalesce(exempt, none), F.array(*[F.lit(x) for x in limited]).cast("array<string>")))


def share_of(condition: Column) -> Column:
    """The share of a group's rows for which the condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def measured_gate(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], alarms: Sequence[Rule], warnings: Sequence[Rule] = ()) -> DataFrame:
    """(keys, measures, alarms, warnings, ok): a row per group, with the names of all rules on its measures that hold.

    A group is ok without alarms. A rule that is null does not hold. Measures are partial aggregates, so that a large group
    is no large task.
    """
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    none = F.array().cast("array<string>")
    out = out.withColumn("alarms", all_rules(alarms) if alarms else none).withColumn("warnings", all_rules(warnings) if warnings else none)
    return out.withColumn("ok", F.size("alarms") == 0)
