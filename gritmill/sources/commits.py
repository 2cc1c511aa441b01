"""Lines of a commit log, of a tree listing and of a change listing; which commits are fixes; labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_production_path, is_test_path

#: What the message of a fix looks like.
FIX_PATTERNS = [r"(?i)\b(fix(?:es|ed)?|bug(?:s)?|defect(?:s)?|patch(?:ed)?|resolve(?:s|d)?|issue)\s*#?\d+", r"(?i)^fix(\([^)]*\))?:"]


def log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(commit, parents, message, and all other columns) of lines ``hash|parents|subject``; bars of the subject stay, lines
    with fewer than three parts are left out."""
    parts = F.split(line, r"\|", 3)
    rows = lines.where(F.size(parts) == 3)
    parents = F.filter(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+"), lambda p: p != "")
    return rows.select("*", F.trim(F.get(parts, F.lit(0))).alias("commit"), parents.alias("parents"), F.trim(F.get(parts, F.lit(2))).alias("message")).drop(line)


def tree_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(mode, type, blob, path, and all other columns) of lines ``mode type hash<TAB>path``; others are left out."""
    halves = F.split(line, "\t", 2)
    meta = F.split(F.get(halves, F.lit(0)), r"\s+")
    return lines.where((F.size(halves) == 2) & (F.size(meta) >= 3)).select("*", F.get(meta, F.lit(0)).alias("mode"), F.get(meta, F.lit(1)).alias("type"), F.get(meta, F.lit(2)).alias("blob"), F.get(halves, F.lit(1)).alias("path")).drop(line)


def change_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, path, and all other columns) of lines ``status<white space>path``; blank lines are left out."""
    parts = F.split(F.col(line), r"\s+", 2)
    return lines.where(F.size(F.filter(parts, lambda p: p != "")) == 2).select("*", F.get(parts, F.lit(0)).alias("status"), F.get(parts, F.lit(1)).alias("path")).drop(line)


def is_fix(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return m.rlike(FIX_PATTERNS[0]) | m.rlike(FIX_PATTERNS[1])


def fixes(commits: DataFrame, changes: DataFrame, largest: int = 10) -> DataFrame:
    """(commit, parent, path): modified production files of fixes with one parent that modify 1 to ``largest`` of them."""
    mine = commits.where((F.size("parents") == 1) & is_fix(F.col("message"))).select("commit", F.get("parents", F.lit(0)).alias("parent")).distinct()
    files = changes.where((F.col("status") == "M") & is_production_path(F.col("path")) & ~is_test_path(F.col("path"))).select("commit", "path").distinct()
    few = files.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= largest).select("commit")
    return mine.join(few, "commit").join(files, "commit").select("commit", "parent", "path")


def labelled(fixed: DataFrame, trees: DataFrame, seed: str = "42", per_commit: int = 2, per_path: int = 2) -> DataFrame:
    """(commit, path, blob, label): 1 for files at the parent that a fix modifies, each (path, blob) once, at its smallest
    commit; 0 for untouched production files, a sampling feature: by a seeded hash at most as many as the fix modifies and
    at most ``per_commit`` of a commit, each (path, blob) once and at most ``per_path`` of a path, counted by the hash. trees:
    (commit, path, blob, type) of the parent's tree, commit being the fix. Reruns choose the same rows."""
    t = trees.where((F.col("type") == "blob") & is_production_path(F.col("path")) & ~is_test_path(F.col("path"))).select("commit", "path", "blob").distinct()
    touched = fixed.select("commit", "path").distinct()
    positive = t.join(touched, ["commit", "path"], "left_semi").groupBy("path", "blob").agg(F.min("commit").alias("commit"))
    wanted = touched.groupBy("commit").agg(F.least(F.count("*"), F.lit(per_commit)).alias("n"))
    clean = t.join(wanted, "commit").join(touched, ["commit", "path"], "left_anti")
    draw = F.sha2(F.concat_ws("|", F.lit(seed), "commit", "path", "blob").cast("binary"), 256)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h", "commit", "path", "blob"))
    drawn = clean.withColumn("h", draw).withColumn("a", rank("path", "blob")).where("a = 1").withColumn("b", rank("path")).where(F.col("b") <= per_path).withColumn("c", rank("commit")).where("c <= n")
    return positive.select("commit", "path", "blob", F.lit(1).alias("label")).union(drawn.select("commit", "path", "blob", F.lit(0)))
