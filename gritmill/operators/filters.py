"""Filters and sorts that a caller's parameters choose, and writes that keep what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def one_of(column: Column, value: str | None, nothing: str | None = None) -> Column | None:
    """Equality without regard to case; None (no condition) for no value or the value that switches the filter off."""
    return None if value is None or (nothing is not None and value.upper() == nothing) else F.upper(column) == value.upper()


def in_list(column: Column, values: str | None) -> Column | None:
    """Membership in a comma-separated list, without regard to case and outer white space; empty parts count for nothing."""
    parts = [v.strip().upper() for v in (values or "").split(",") if v.strip()]
    return F.upper(column).isin(parts) if parts else None


def or_null(column: Column, value: str | None, sentinel: str = "unassigned") -> Column | None:
    """Equality, or IS NULL for the sentinel."""
    return None if value is None else column.isNull() if value == sentinel else column == value


def scope(direct: Column, value: str | None) -> Column | None:
    """direct, transitive, or all."""
    return {"direct": direct, "transitive": ~direct}.get((value or "").lower())


def number_or_id(number: Column, id_: Column, value: str) -> Column:
    """A row's number for digits alone, else its id; digits may also be an id."""
    return (id_ == value) | (number == int(value)) if value.isdigit() else id_ == value


def ordered(df: DataFrame, by: str | None, allowed: dict[str, Column], default: str, descending: bool = True, ties: list[str] = ()) -> DataFrame:
    """Rows sorted by an allowed column, by the default one for other names; nulls last, ties by ``ties``."""
    c = allowed.get(by or default, allowed[default])
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def page_bounds(size: int | None, number: int | None, largest: int = 100) -> tuple[int, int]:
    """Page size within 1..largest and a page number of at least 1."""
    return max(1, min(largest, 20 if size is None else size)), max(1, number or 1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by all other columns, so that ties don't matter; null keys are one key.
    One aggregation with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.row.{c}").alias(c) for c in rest])


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """All target rows, and source rows whose key the target has not; null keys match null keys."""
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return target.unionByName(source.alias("s").join(target.select(*keys).alias("t"), same, "left_anti"))


def upsert_keeping(target: DataFrame, source: DataFrame, keys: list[str], kept: list[str], unless: Column | None = None) -> DataFrame:
    """Upsert that takes a matched row's values from the source but its ``kept`` columns from the target; target rows for
    which ``unless`` holds stay as they are. One full join; null keys match null keys."""
    columns = target.columns
    t = target.select(F.struct(*columns).alias("t"), F.coalesce(unless, F.lit(False)).alias("__hold") if unless is not None else F.lit(False).alias("__hold"))
    s = source.select(F.struct(*columns).alias("s"))
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    j = t.join(s, same, "full")
    old = F.col("s").isNull() | F.coalesce(F.col("__hold"), F.lit(False))
    return j.select(*[F.when(old, F.col(f"t.{c}")).when(F.col("t").isNotNull() & F.lit(c in kept), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns])
