"""Filters as DataFrame -> DataFrame or Column functions; all of them reach the scan as pushed filters where Parquet allows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many values a membership test becomes a semi-join.
LONG_LIST = 500


def where_all(df: DataFrame, **wanted: object) -> DataFrame:
    """Conjunction of column == value for those values that aren't None."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def tenant(df: DataFrame, column: str, user: str) -> DataFrame:
    """Rows of one user, whose id stands there raw or hashed."""
    from gristmill.functions.strings import tenant_hash

    return df.where((F.col(column) == F.lit(user)) | (F.col(column) == tenant_hash(F.lit(user))))


def owned_or_public(df: DataFrame, owner: str, user: object) -> DataFrame:
    return df.where(F.col(owner).isNull() | (F.col(owner) == F.lit(user)))


def owned(df: DataFrame, key: str, owners: DataFrame, owner: str, user: object) -> DataFrame:
    """Rows whose key is owned by the user in the table of owners."""
    return df.join(owners.where(F.col(owner) == F.lit(user)).select(key), key, "left_semi")


def contains_ci(column: str, needle: str) -> Column:
    return F.col(column).ilike(f"%{needle}%")


def like_lower(column: str, needle: str) -> Column:
    """Only the needle is lower-cased."""
    return F.col(column).like(f"%{needle.lower()}%")


def any_keyword(column: str, words: Iterable[str]) -> Column:
    return reduce(or_, (F.col(column).contains(w) for w in words))


def any_prefix(column: str, prefixes: Iterable[str]) -> Column:
    return reduce(or_, (F.col(column).startswith(p) for p in prefixes))


def member_of(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is among the values: an IN list, or a semi-join for a long one."""
    if len(values) <= LONG_LIST:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return df.join(wanted, column, "left_semi")


def in_array(column: str, value: object) -> Column:
    return F.array_contains(F.col(column), value)


def scalar_or_element(scalar: str, structs: str, field: str, value: object) -> Column:
    """The scalar equals the value, or a struct of the array has it in a field."""
    return (F.col(scalar) == F.lit(value)) | F.exists(F.col(structs), lambda s: s[field] == F.lit(value))


def json_field(column: str, path: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{path}")


def override(column: Column, rules: Mapping[str, Column], otherwise: str) -> Column:
    """The column unless empty, else the name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(list(rules.items())):
        out = F.when(rule, name).otherwise(out)
    return F.coalesce(F.nullif(column, F.lit("")), out)


def current(column: str = "valid_until") -> Column:
    return F.col(column).isNull()


def unflagged(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def older_than(column: str, now: str, days: int) -> Column:
    return F.col(column) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def unexpired(revoked: str, expires: str, now: str) -> Column:
    return F.col(revoked).isNull() & (F.col(expires) > F.lit(now).cast("timestamp_ntz"))


def not_in_or_null(column: str, values: list) -> Column:
    return ~F.col(column).isin(values) | F.col(column).isNull()


def scoped(df: DataFrame, column: str, scopes: Mapping[str, list[str]], wanted: list[str]) -> DataFrame:
    """Rows whose type belongs to a wanted scope; unknown scopes give nothing."""
    types = [t for s in wanted for t in scopes.get(s, [])]
    return df.where(F.col(column).isin(types)) if types else df.where(F.lit(False))


def apply_view(df: DataFrame, spec: Mapping[str, object], **arguments: object) -> DataFrame:
    """A stored filter specification, which overrides the arguments: equality by column, min_/max_ prefixes for bounds."""
    for name, value in {**arguments, **spec}.items():
        if value is None:
            continue
        if name.startswith("min_"):
            df = df.where(F.col(name[4:]) >= F.lit(value))
        elif name.startswith("max_"):
            df = df.where(F.col(name[4:]) <= F.lit(value))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def exact_name(column: str, wanted: str) -> Column:
    return F.col(column) == F.lower(F.trim(F.lit(wanted)))
