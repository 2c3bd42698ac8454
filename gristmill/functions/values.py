"""Date, number, array and JSON functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_interval(passes: Column, failed: Column, days: tuple[int, ...] = (1, 3, 7, 14, 30, 60)) -> Column:
    """Days to the next review by the number of passes so far; the first again after a failure."""
    table = F.array(*[F.lit(x) for x in days])
    return F.when(failed, F.lit(days[0])).otherwise(F.element_at(table, F.least(passes, F.lit(len(days) - 1)).cast("int") + 1))


def due(last: Column, now: Column, hours: Column) -> Column:
    """Never checked, or as long ago as the interval."""
    return last.isNull() | (now >= F.dateadd_hours(last, hours) if hasattr(F, "dateadd_hours") else now >= last + F.make_dt_interval(F.lit(0), hours))


def age_bucket(hours: Column, active: Column) -> Column:
    return F.when(~active, "idle").when(hours <= 6, "fresh").when(hours <= 24, "aging").otherwise("stale")


def tier(similarity: Column, strong: float = 0.6, medium: float = 0.4) -> Column:
    return F.when(similarity >= strong, "strong").when(similarity >= medium, "medium").otherwise("weak")


def backfill_order(dense: Column, lexical: Column) -> Column:
    """The dense rank, and after all of those the lexical one."""
    return F.coalesce(dense, F.lit(100_000) + lexical)


def appended(values: Column, value: Column, empty: str) -> Column:
    """The array, or an empty one of the given type for null, with one more element."""
    return F.concat(F.coalesce(values, F.expr(f"cast(array() as {empty})")), F.array(value))


def without(values: Column, value: object) -> Column:
    return F.array_remove(values, value)


def length_or_zero(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)).cast("bigint")


def with_key(map_: Column, key: str, value: Column) -> Column:
    """The map with the key set."""
    return F.map_concat(F.map_filter(map_, lambda k, v: k != key), F.create_map(F.lit(key), value))


def sources_or_scalar(sources: Column, scalar: Column) -> Column:
    """The non-null sources, each once in order, else the scalar alone."""
    some = F.array_distinct(F.filter(sources, lambda s: s.isNotNull()))
    return F.when(F.size(some) > 0, some).otherwise(F.array(scalar))


def event_verdict(a_actors: Column, b_actors: Column, years: Column, same_type: Column, same_place: Column) -> Column:
    """same, maybe or different from four comparisons."""
    actors = F.arrays_overlap(a_actors, b_actors)
    return F.when((years == "far") | ~same_type, "different").when(actors & same_place & (years == "overlap"), "same").otherwise("maybe")
