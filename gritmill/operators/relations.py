"""Relationships between files and symbols: imports, inheritance and calls, resolved by equi joins.

All sides of the joins grow with the files, and their sizes are guessed too low, so each asks for a merge join: none is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may follow an import's path to name a file, in the order in which it is tried.
IMPORT_ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", ".py", ".java", "/index.js"]


def joined_path(folder: Column, path: Column) -> Column:
    """A relative path from a folder, without . and .. where they can go; leading .. stay."""
    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when((part == "") | (part == "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(F.concat(folder, F.lit("/"), path), "/"), F.array().cast("array<string>"), step)
    bare = F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))
    return F.when(path.endswith("/") & (bare != "."), F.concat(bare, F.lit("/"))).otherwise(bare)


def resolved_imports(imports: DataFrame, files: DataFrame, endings: list[str] = IMPORT_ENDINGS) -> DataFrame:
    """The imports (file, target and any other columns) with ``resolved``: the first existing file that a relative target may
    name, the bare joined path if there is none, and any other target as it is. Null targets resolve to null."""
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    local = F.col("target").startswith(".")
    rows = imports.withColumn("__path", F.when(local, joined_path(folder, F.col("target"))))
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(endings)])
    tried = rows.where(local).select("__path").distinct().select("__path", F.explode(ends).alias("x")).select("__path", F.col("x.i").alias("i"), F.concat("__path", "x.e").alias("path"))
    hit = tried.join(files.select("path").distinct().hint("merge"), "path").groupBy("__path").agg(F.min_by("path", "i").alias("__hit"))
    return rows.join(hit.hint("merge"), "__path", "left").withColumn("resolved", F.when(local, F.coalesce("__hit", "__path")).otherwise(F.col("target"))).drop("__path", "__hit")


def relationships(files: DataFrame, imports: DataFrame, inheritance: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(type, source_file, source_symbol, target_file, target_symbol, name): IMPORTS, EXTENDS, IMPLEMENTS and CALLS.

    imports: file, target, symbols, line; inheritance: file, class_name, parent, is_interface, line; calls: file, caller,
    callee, line; symbols: file, name, type, line. A parent is the first class of that name (or interface, for interfaces) by
    file and line. A callee is a symbol of its own file, else of the first import by line that names it or a star. Targets
    that nothing defines are null. Of equal names in a file the last one stands."""
    found = resolved_imports(imports, files)
    a = found.select(F.lit("IMPORTS").alias("type"), F.col("file").alias("source_file"), F.lit(None).cast("string").alias("source_symbol"), F.col("resolved").alias("target_file"), F.lit(None).cast("string").alias("target_symbol"), F.array_join("symbols", ",").alias("name"))
    one = symbols.groupBy("file", "name").agg(F.max_by("type", "line").alias("type"), F.max("line").alias("line"))
    first = lambda kinds: one.where(F.col("type").isin(*kinds)).groupBy(F.col("name").alias("parent")).agg(F.min_by("file", F.struct("file", "line")).alias("target_file"))

    def heirs(rows, kind, kinds):
        return rows.join(first(kinds).hint("merge"), "parent", "left").select(F.lit(kind).alias("type"), F.col("file").alias("source_file"), F.col("class_name").alias("source_symbol"), "target_file", F.when(F.col("target_file").isNotNull(), F.col("parent")).alias("target_symbol"), F.col("parent").alias("name"))

    b = heirs(inheritance.where("parent is not null and not is_interface"), "EXTENDS", ["CLASS"])
    c = heirs(inheritance.where("parent is not null and is_interface"), "IMPLEMENTS", ["CLASS", "INTERFACE"])
    known = one.select(F.col("file").alias("target_file"), F.col("name").alias("callee"))
    asked = calls.select("file", "callee").distinct()
    own = asked.join(known.withColumnRenamed("target_file", "file").hint("merge"), ["file", "callee"], "left_semi").select("file", "callee", F.col("file").alias("target_file"), F.lit(-1).cast("long").alias("rank"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("line", "target")).cast("long"))
    named = ranked.select("file", "rank", F.col("resolved").alias("target_file"), F.explode("symbols").alias("callee"))
    through = asked.join(named.where("callee <> '*'").hint("merge"), ["file", "callee"]).select("file", "callee", "target_file", "rank")
    star = asked.join(named.where("callee = '*'").drop("callee").hint("merge"), "file").select("file", "callee", "target_file", "rank")
    via = through.union(star).join(known.hint("merge"), ["target_file", "callee"], "left_semi").select("file", "callee", "target_file", "rank")
    best = own.union(via).groupBy("file", "callee").agg(F.min_by("target_file", "rank").alias("target_file"))
    d = calls.join(best.hint("merge"), ["file", "callee"], "left").select(F.lit("CALLS").alias("type"), F.col("file").alias("source_file"), F.col("caller").alias("source_symbol"), "target_file", F.when(F.col("target_file").isNotNull(), F.col("callee")).alias("target_symbol"), F.col("callee").alias("name"))
    return a.union(b).union(c).union(d)
