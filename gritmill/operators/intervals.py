"""Islands, interval unions and overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """The union of closed integer intervals by key; those at most ``gap`` apart are joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= before + gap, 0).otherwise(1)).over(w)
    return df.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers by key: first, last and their number."""
    rows = df.select(*keys, value).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return rows.withColumn("__run", F.col(value) - rank).groupBy(*keys, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("__run")


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of (a_id, a_start, a_end) and (b_id, b_start, b_end) that overlap. Both sides are cut into cells of
    ``width`` and joined on the cell; a pair is kept in the first cell it shares, so nothing is made distinct."""
    def cells(df, s, e):
        return df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))

    joined = cells(a, "a_start", "a_end").join(cells(b, "b_start", "b_end"), "__cell")
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return joined.where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.col("__cell") == first)).drop("__cell")
