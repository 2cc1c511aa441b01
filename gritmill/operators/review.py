"""Review of a change: structural deltas, smells that came or went, risk points, the quality gate and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp, risk_class, round_half_up


def structural_deltas(old: DataFrame, new: DataFrame, keys: list[str] = ("file", "symbol")) -> DataFrame:
    """(keys, complexity_delta, nesting_delta) of functions in both versions; new ones count from 0, removed ones are left
    out. Keys that repeat on a side must be made distinct before; null keys match nothing on the old side."""
    a = old.select(*keys, F.col("complexity").alias("__c"), F.col("nesting").alias("__n"))
    d = lambda now, before: (F.coalesce(now, F.lit(0)) - F.coalesce(before, F.lit(0)))
    return new.join(a, list(keys), "left").select(*keys, d("complexity", "__c").alias("complexity_delta"), d("nesting", "__n").alias("nesting_delta"))


def smell_delta(old: DataFrame, new: DataFrame, keys: list[str] = ("rule", "file", "symbol")) -> DataFrame:
    """(keys, state) with state new, pre-existing or fixed; null keys (no symbol) match each other; repeats count once."""
    sides = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(*keys, F.lit(0), F.lit(1)))
    seen = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return seen.select(*keys, F.when(F.col("o") == 0, "new").when(F.col("n") == 0, "fixed").otherwise("pre-existing").alias("state"))


def churn_points(churn: Column) -> Column:
    return F.least(F.lit(25), round_half_up(F.coalesce(churn, F.lit(0)) * 25 / 1000))


def structural_points(complexity: Column, nesting: Column) -> Column:
    up = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return F.least(F.lit(20), F.least(F.lit(12), round_half_up(up(complexity) * 1.5)) + F.least(F.lit(8), up(nesting) * 2))


def smell_points(high: Column, medium: Column, other: Column) -> Column:
    return F.least(F.lit(25), high * 10 + medium * 5 + other * 2)


def blast_points(direct: Column, transitive: Column) -> Column:
    return F.least(F.lit(15), round_half_up(direct * 3 + transitive * 1.5))


def defect_points(worst: Column) -> Column:
    return F.when(worst >= 80, 15).when(worst >= 60, 10).when(worst >= 40, 5).otherwise(0)


def assessed(changes: DataFrame) -> DataFrame:
    """The changes with score, category, gate and reasons.

    Columns: files, churn, complexity_delta, nesting_delta, high, medium, other (new smells), extreme (a new smell of
    complexity of at least 25), direct, transitive, affected_files, worst_defect, risky_files. Null counts as 0 and false.
    A change without files scores 0, is LOW and APPROVED. The first gate that holds wins; reasons are those of that gate."""
    names = ["files", "churn", "complexity_delta", "nesting_delta", "high", "medium", "other", "direct", "transitive", "affected_files", "worst_defect", "risky_files"]
    full = changes.fillna(0, names).fillna(False, ["extreme"])
    c = F.col
    points = (
        churn_points(c("churn")) + structural_points(c("complexity_delta"), c("nesting_delta")) + smell_points(c("high"), c("medium"), c("other"))
        + blast_points(c("direct"), c("transitive")) + defect_points(c("worst_defect"))
    )
    full = full.withColumn("score", F.when(c("files") == 0, 0).otherwise(clamp(5 + points, 0, 100)).cast("long"))
    s, n, big, broad = c("score"), c("high") > 0, c("churn") > 500, c("affected_files") >= 3
    wide = (c("affected_files") >= 15) & n
    said = lambda *pairs: F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))
    gates = [
        ("BLOCKED", (s >= 85) | c("extreme") | wide, said((s >= 85, "SCORE_85"), (c("extreme"), "EXTREME_COMPLEXITY"), (c("affected_files") >= 15, "CRITICAL_BLAST_RADIUS"))),
        ("CHANGES_REQUESTED", n | (c("complexity_delta") >= 10) | (s >= 60) | (c("risky_files") >= 2), said((n, "NEW_HIGH_SMELL"), (c("complexity_delta") >= 10, "COMPLEXITY_JUMP"), (s >= 60, "SCORE_60"), (c("risky_files") >= 2, "RISKY_FILES"))),
        ("WARNING", (c("medium") > 0) | (s >= 35) | big | broad, said((c("medium") > 0, "NEW_MEDIUM_SMELL"), (s >= 35, "SCORE_35"), (big, "LARGE_CHURN"), (broad, "BROAD_BLAST_RADIUS"))),
    ]
    gate, reasons = F.lit("APPROVED"), F.array().cast("array<string>")
    for name, cond, why in reversed(gates):
        gate, reasons = F.when(cond, name).otherwise(gate), F.when(cond, why).otherwise(reasons)
    some = c("files") > 0
    return full.select("*", risk_class(s, 30).alias("category"), F.when(some, gate).otherwise("APPROVED").alias("gate"), F.when(some, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def change_findings(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finding, severity) of whole changes: broad blast radius and large churn. Columns as of :func:`assessed`."""
    a, hits = F.col("affected_files"), []
    hits.append(F.when(a >= 3, F.struct(F.lit("BROAD_BLAST_RADIUS").alias("finding"), F.when(a >= 8, "high").otherwise("medium").alias("severity"))))
    hits.append(F.when(F.col("churn") > 500, F.struct(F.lit("LARGE_CHURN").alias("finding"), F.lit("medium").alias("severity"))))
    return changes.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*keys, "f.*")


def item_findings(deltas: DataFrame, smells: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finding, severity, file) of the parts of changes: functions whose complexity grew by 3 or more (high from 5),
    new smells (with their own severity), files of a defect score of 60 or more (high from 80)."""
    a = deltas.where("complexity_delta >= 3").select(*keys, F.lit("COMPLEXITY_INCREASE").alias("finding"), F.when(F.col("complexity_delta") >= 5, "high").otherwise("medium").alias("severity"), "file")
    b = smells.where("state = 'new'").select(*keys, F.lit("NEW_CODE_SMELL").alias("finding"), "severity", "file")
    c = files.where("score >= 60").select(*keys, F.lit("HIGH_DEFECT_PROPENSITY_FILE").alias("finding"), F.when(F.col("score") >= 80, "high").otherwise("medium").alias("severity"), "file")
    return a.unionByName(b).unionByName(c)
