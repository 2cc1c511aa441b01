"""Snapshots of a code base: smells, test presence, features, profiles, and comparisons between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp, metric_delta, round_half_up
from .relational import rule_rows

#: Limits that a measure must exceed to be a smell.
LIMITS = {"LARGE_FILE": 500, "HIGH_IMPORT_COUNT": 20, "HIGH_DEPENDENT_COUNT": 10, "LARGE_FUNCTION": 50, "HIGH_COMPLEXITY": 10, "DEEP_NESTING": 4}
#: Endings of a file's companion test.
TEST_ENDINGS = [".test.js", ".spec.js", ".test.jsx", ".spec.jsx", "_test.py", "Test.java"]


def file_smells(files: DataFrame, keys: list[str], limits: dict[str, int] = LIMITS) -> DataFrame:
    """(keys, rule, severity, measured) of files with lines, import_count and fan_in; null measures break no rule."""
    return rule_rows(files, keys, [
        ("LARGE_FILE", "medium", F.col("lines") > limits["LARGE_FILE"], F.col("lines")),
        ("HIGH_IMPORT_COUNT", "low", F.col("import_count") > limits["HIGH_IMPORT_COUNT"], F.col("import_count")),
        ("HIGH_DEPENDENT_COUNT", "medium", F.col("fan_in") > limits["HIGH_DEPENDENT_COUNT"], F.col("fan_in")),
    ])


def function_smells(functions: DataFrame, keys: list[str], limits: dict[str, int] = LIMITS) -> DataFrame:
    """(keys, rule, severity, measured) of functions with lines, complexity and nesting; complexity over twice its limit is
    high."""
    c, top = F.col("complexity"), limits["HIGH_COMPLEXITY"]
    return rule_rows(functions, keys, [
        ("LARGE_FUNCTION", "medium", F.col("lines") > limits["LARGE_FUNCTION"], F.col("lines")),
        ("HIGH_COMPLEXITY", "medium", (c > top) & (c <= 2 * top), c),
        ("HIGH_COMPLEXITY", "high", c > 2 * top, c),
        ("DEEP_NESTING", "medium", F.col("nesting") > limits["DEEP_NESTING"], F.col("nesting")),
    ])


def names_test(path: Column) -> Column:
    """Whether a path itself counts as a test here; wider than :func:`~gritmill.functions.paths.is_test_path`."""
    p = F.lower(path)
    return p.rlike(r"\.(test|spec)\.|^test_|_test\.py$|test\.java$|/(tests|test|__tests__)/")


def has_test(files: DataFrame) -> DataFrame:
    """(path, has_test): 1 for tests and for files with a companion test beside them or below test/ or tests/, else 0.

    Each path gives its eighteen possible companions to one equi join; each path has one row, null paths have none."""
    paths = files.select("path").where("path is not null").distinct()
    base = F.regexp_replace("path", r"\.[^/.]+$", "")
    names = F.array(*[F.concat(F.lit(front), base, F.lit(e)) for e in TEST_ENDINGS for front in ("", "test/", "tests/")])
    found = paths.select("path", F.explode(names).alias("test")).join(paths.select(F.col("path").alias("test")), "test", "left_semi").select("path").distinct().withColumn("n", F.lit(1))
    return paths.join(found, "path", "left").select("path", F.when(names_test(F.col("path")), 1).otherwise(F.coalesce("n", F.lit(0))).alias("has_test"))


def file_features(files: DataFrame, functions: DataFrame, smells: DataFrame) -> DataFrame:
    """(path, the eleven measures that score a file). files: path, lines, class_count, import_count, export_count, fan_in,
    fan_out, has_test; functions: path, complexity; smells: path. A file without functions has complexity 0."""
    f = functions.groupBy("path").agg(F.count("*").alias("function_count"), F.round(F.avg("complexity"), 2).alias("avg_complexity"), F.max("complexity").alias("max_complexity"))
    s = smells.groupBy("path").agg(F.count("*").alias("code_smell_count"))
    zero = ["function_count", "avg_complexity", "max_complexity", "code_smell_count", "fan_in", "fan_out", "has_test"]
    return files.join(f, "path", "left").join(s, "path", "left").fillna(0, zero).select(
        "path", "lines", "function_count", "class_count", "import_count", "export_count", "avg_complexity", "max_complexity", "fan_in", "fan_out", "code_smell_count", "has_test"
    )


def as_entities(features: DataFrame, kind: str, id_col: str) -> DataFrame:
    """(entity_type, entity_id, feature_name, feature_value): one row for each measure of each entity."""
    names = [c for c in features.columns if c != id_col]
    wide = features.select(F.col(id_col).alias("entity_id"), *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(["entity_id"], names, "feature_name", "feature_value").select(F.lit(kind).alias("entity_type"), "entity_id", "feature_name", "feature_value")


def maintainability(complexity: Column, duplication: Column, smells: Column) -> Column:
    """Between 10 and 100, of a whole snapshot."""
    return clamp(round_half_up(100 - complexity * 2.5 - duplication * 30 - smells * 1.5), 10, 100).cast("int")


def profile(files: DataFrame, group: list[str]) -> DataFrame:
    """(group, files, lines, avg_complexity, max_complexity, smells, guard_pct) of files with lines, complexity, smells and
    has_test. A complexity of null or 0 counts as 1; the mean has two decimals, the guarded share in percent has one."""
    c = F.when(F.coalesce("complexity", F.lit(0)) == 0, 1).otherwise(F.col("complexity"))
    return files.groupBy(*group).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.round(F.avg(c), 2).alias("avg_complexity"), F.max(c).alias("max_complexity"),
        F.coalesce(F.sum("smells"), F.lit(0)).alias("smells"), F.round(F.count_if(F.col("has_test") > 0) * 100 / F.count("*"), 1).alias("guard_pct"),
    )


def file_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, deltas, is_regression, is_improvement, factors) of files with lines, complexity and smells.

    A file is MODIFIED if any measure differs; a regression if complexity or smells grew, an improvement if either fell; it
    may be both. Over 50 more lines with more complexity is a factor of its own. Keys must be distinct on each side; null
    measures count as 0; a null key is a file of its own on each side."""
    names = ["lines", "complexity", "smells"]
    a = old.fillna(0, names).select(*keys, *[F.col(n).alias(f"__{n}") for n in names], F.lit(True).alias("__old"))
    b = new.fillna(0, names).select(*keys, *names, F.lit(True).alias("__new"))
    both = F.col("__old") & F.col("__new")
    d = {n: F.when(both, F.col(n) - F.col(f"__{n}")) for n in names}
    more, smelly, large = d["complexity"] > 0, d["smells"] > 0, (d["lines"] > 50) & (d["complexity"] > 0)
    factors = F.array_compact(F.array(F.when(more, "COMPLEXITY_INCREASED"), F.when(smelly, "SMELLS_INTRODUCED"), F.when(large, "LARGE_CHURN_WITH_COMPLEXITY")))
    changed = (d["lines"] != 0) | (d["complexity"] != 0) | (d["smells"] != 0)
    change = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").when(changed, "MODIFIED").otherwise("UNCHANGED")
    return a.join(b, keys, "full").select(
        *keys, change.alias("change"), *[d[n].alias(f"{n}_delta") for n in names], F.coalesce(more | smelly, F.lit(False)).alias("is_regression"),
        F.coalesce((d["complexity"] < 0) | (d["smells"] < 0), F.lit(False)).alias("is_improvement"), factors.alias("factors"),
    )


def compared(old: DataFrame, new: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, previous, current, absolute_delta, percentage_delta) of two one-row profiles. Without an old row (a
    baseline) previous and both deltas are null."""
    rows = lambda df, name: df.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], measures, "measure", name)
    joined = rows(new, "current").join(rows(old, "previous").withColumn("__old", F.lit(True)), "measure", "left")
    delta = metric_delta(F.col("previous"), F.col("current"))
    return joined.select(
        "measure", "previous", "current", F.when(F.col("__old"), delta["absoluteDelta"]).alias("absolute_delta"), F.when(F.col("__old"), delta["percentageDelta"]).alias("percentage_delta")
    )


def clone_trajectory(old: DataFrame, new: DataFrame, key: str = "clone_hash") -> DataFrame:
    """(key, state) of clone groups with their instances: NEW, RESOLVED, CHANGED (another number of instances) or
    PERSISTENT. Keys must be distinct on each side."""
    a, b = old.select(key, F.col("instances").alias("o")), new.select(key, F.col("instances").alias("n"))
    state = F.when(F.col("o").isNull(), "NEW").when(F.col("n").isNull(), "RESOLVED").when(F.col("o") != F.col("n"), "CHANGED").otherwise("PERSISTENT")
    return a.join(b, key, "full").select(key, state.alias("state"))


def health_table(metrics: DataFrame, predictions: DataFrame, duplication: DataFrame, key: str = "path") -> DataFrame:
    """Metrics of files with their predicted score and duplicated lines: two left joins; files without one have null score
    and no duplicated lines."""
    return metrics.join(predictions.select(key, "score"), key, "left").join(duplication.select(key, "duplicated_lines"), key, "left").fillna(0, ["duplicated_lines"])


def hotspots_or_complex(files: DataFrame, n: int = 10) -> DataFrame:
    """A feature: the ``n`` worst files by score, then lines; without any score, those of the greatest complexity. Ties go
    to the smaller path."""
    scored = files.select(F.coalesce(F.count("score") > 0, F.lit(False)).alias("scored"))
    rank = F.struct(F.when(F.col("scored"), F.col("score")).otherwise(F.col("complexity")).alias("by"), "lines")
    return files.join(scored).orderBy(rank["by"].desc_nulls_last(), F.desc("lines"), "path").limit(n).drop("scored")  # one row joins
