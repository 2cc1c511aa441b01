"""Parts of a labelled table that share no group, and their files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}
#: Strata of the share of positives, and bins of hashes (a power of two) within each.
STRATA, BINS = 4, 1024


def seeded(column: F.Column, seed: str) -> F.Column:
    """60 bits of the MD5 of a value, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(column.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def group_parts(rows: DataFrame, group: str, label: str, shares: dict[str, float] = SHARES, seed: str = "split") -> DataFrame:
    """(group, rows, positives, part): every group in one part.

    Groups fall into strata by their share of positives and are taken in the order of a seeded hash; a group goes where the
    middle of its rows falls among the stratum's. So a part has its share of each stratum's rows but for half a group at
    either end, whatever the number of groups. The running sums go by bins of the hash, then within a bin: no task sorts
    all groups. A null group is a group; null labels are no positives. An empty table gives an empty result."""
    g = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
    g = g.withColumn("stratum", F.least(F.lit(STRATA - 1), F.floor(F.col("positives") * STRATA / F.col("rows")))).withColumn("u", seeded(F.col("group"), seed))
    g = g.withColumn("bin", F.shiftright("u", 60 - BINS.bit_length() + 1))
    bins = g.groupBy("stratum", "bin").agg(F.sum("rows").alias("n"))
    order = Window.partitionBy("stratum").orderBy("bin")  # at most BINS rows each
    before = bins.select("stratum", "bin", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("total"))
    upto = F.sum("rows").over(Window.partitionBy("stratum", "bin").orderBy("u", F.col("group").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    placed = g.withColumn("upto", upto).join(before, ["stratum", "bin"])
    middle = (F.col("before") + F.col("upto") - F.col("rows") / 2) / F.col("total")
    part, end = F.lit(None).cast("string"), 1.0
    for name, share in reversed(shares.items()):
        part = F.when(middle < end, name).otherwise(part) if end < 1 else F.lit(name)
        end = round(end - share, 12)
    return placed.select("group", "rows", "positives", part.alias("part"))


def with_part(rows: DataFrame, group: str, label: str, **options) -> DataFrame:
    """The rows with the part of their group; a column ``part`` is replaced."""
    parts = group_parts(rows, group, label, **options).select(F.struct("group", "part").alias("__p"))
    return rows.drop("part").join(parts, F.col(group).eqNullSafe(F.col("__p.group"))).withColumn("part", F.col("__p.part")).drop("__p")


def write_parts(rows: DataFrame, path: str, label: str) -> dict:
    """Writes a CSV folder with a header for each part, and a manifest of the parts' rows and positive rates beside them, which
    is returned. ``rows`` has a column part."""
    rows.write.mode("overwrite").option("header", True).partitionBy("part").csv(f"{path}/parts")
    stats = {r["part"]: {"rows": r["n"], "positives": r["k"], "positive_rate": round(r["k"] / r["n"], 4)} for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("k")).collect()}
    manifest = {"columns": [c for c in rows.columns if c != "part"], "parts": dict(sorted(stats.items()))}
    rows.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest
