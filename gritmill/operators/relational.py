"""Combinators for latest rows, diffs, pivots, pages, merges and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pct_delta


def latest_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is last by ``order``: one aggregation with map-side combining, no sort and no window,
    so that a hot group costs no task its memory. Null keys are a group; rows with a null in ``order`` come before others; of
    rows that tie in all of ``order`` any one is taken, so it should be unique. An empty table gives an empty result."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def pivot_sum(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide by conditional sums (missing: 0): one aggregation whatever the number of names. Null keys are a group,
    null values count as missing, repeated rows each count."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(name) == n, F.col(value)).otherwise(0)).alias(n) for n in names])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two snapshots with both values and their change: ADDED, REMOVED, MODIFIED or UNCHANGED. Null keys match null
    keys; keys must be distinct on each side, else each pair of rows counts. An empty side makes all rows ADDED or REMOVED."""
    a = old.select(F.struct(*keys, value).alias("a"))
    b = new.select(F.struct(*keys, value).alias("b"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    old_value, new_value = F.col(f"a.{value}"), F.col(f"b.{value}")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(~old_value.eqNullSafe(new_value), "MODIFIED").otherwise("UNCHANGED")
    key = lambda k: F.when(F.col("a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k)
    return a.join(b, same, "full").select(*[key(k) for k in keys], old_value.alias("old_value"), new_value.alias("new_value"), change.alias("change"))


def lag_deltas(df: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds previous value, delta, percentage and whether the row is a baseline. Meant for rows already aggregated, one for each place of the
    order: rows that tie follow each other in any order, nulls come first. Null keys are a group; without keys all rows are
    one, which one task sorts."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    prev = F.lag(value).over(w)
    return (
        df.withColumn("previous", prev)
        .withColumn("delta", F.col(value) - F.coalesce("previous", F.col(value)))
        .withColumn("pct", F.round(F.when(F.col("previous").isNull(), 0.0).otherwise(pct_delta(F.col("previous"), F.col(value))), 2))
        .withColumn("is_baseline", F.col("previous").isNull())
    )


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of a total order; the planner keeps only the first rows of each task."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert without a table format: source rows replace target rows of the same key, all others stay. Null keys match
    null keys; repeated rows stay on either side. An empty source leaves the target as it is."""
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return target.alias("t").join(source.select(*keys).alias("s"), same, "left_anti").unionByName(source)


def rule_rows(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row for each rule that a row breaks, in a single pass: (name, severity, condition, measured value)."""
    hits = [F.when(cond, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), v.cast("double").alias("measured"))) for n, s, cond, v in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*keys, "hit.*")
