"""Endpoints of an interface from its files' declarations: mounts followed from file to file, routes under all prefixes, and
the contract of each handler. All sides of the joins grow with the files, so they are merge joins: none is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_public_route, route_path
from .endpoints import call_depth, completeness, error_coverage
from .relations import resolved_imports
from .rounds import settled

# What may follow an import's path, and the middleware that proves who asks and what they may do.
ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts"]
AUTHENTICATION = [
    "requireauth", "verifytoken", "authenticate", "isauthenticated", "auth", "checkauth", "protect", "jwtauth", "ensureauthenticated", "requirelogin", "tokenauth", "verifyjwt", "validatetoken",
]
AUTHORIZATION = ["requireadmin", "requirerole", "authorize", "haspermission", "verifyownership", "checkownership", "adminonly", "checkrole", "checkpermissions"]


def mounts(declared: DataFrame) -> DataFrame:
    """(file, prefix, target): which file's router a file mounts under which prefix. A name that no import of the file
    brings in from a relative path mounts nothing."""
    imports = declared.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.*")
    named = imports.groupBy("file", "local").agg(F.max_by("target", "line").alias("target")).where(F.col("target").startswith("."))
    found = resolved_imports(named, declared.select("path"), ENDINGS).select("file", F.col("local").alias("name"), F.col("resolved").alias("target"))
    use = declared.select(F.col("path").alias("file"), F.explode("mounts").alias("m")).select("file", "m.*")
    return use.join(found.hint("merge"), ["file", "name"]).select("file", "prefix", "target").distinct()


def prefixes(mounted: DataFrame) -> DataFrame:
    """(file, prefix) of all ways from files that nothing mounts: the prefixes along a way joined. A way that comes back to
    a file of its own ends before it. One round for each step of the longest way; a round joins on the file."""
    edges = settled(mounted)
    roots = edges.select("file").distinct().join(edges.select(F.col("target").alias("file")).distinct().hint("merge"), "file", "left_anti")
    frontier = settled(roots.select("file", F.lit("").alias("prefix"), F.array("file").alias("way")))
    reached = frontier
    while frontier.take(1):
        step = frontier.withColumnRenamed("prefix", "before").join(edges.hint("merge"), "file").where(~F.array_contains("way", F.col("target")))
        frontier = settled(step.select(F.col("target").alias("file"), F.concat("before", F.lit("/"), "prefix").alias("prefix"), F.concat("way", F.array("target")).alias("way")))
        reached = reached.union(frontier)
    found = reached.where(F.size("way") > 1).select("file", "prefix").distinct()
    # files on circles that no root leads to keep their mounts' own prefixes
    alone = edges.select(F.col("target").alias("file"), "prefix").join(reached.select("file").distinct().hint("merge"), "file", "left_anti").distinct()
    return found.union(alone)


def discover(declared: DataFrame) -> DataFrame:
    """(method, path, file, line, router, handler, authenticated, authorized, auth_middleware, middleware, parameters, fields,
    statuses, shapes, downstream, is_async, has_try, database, external, found, is_public, completeness, error_coverage,
    depth) of all endpoints of files read by :func:`sources.routes.read_routes`.

    A route stands under each prefix of its file, or under none if nothing mounts the file. Of routes of one method and
    path the first by file and place counts. Middleware of the router comes before the route's own. A handler that is a
    name is the last function of that name in the first file that has one; without it the contract is UNKNOWN. Files that
    are not read, or declare no route, give nothing."""
    declared = settled(declared)
    route = declared.select(F.col("path").alias("file"), F.col("middleware").alias("shared"), F.explode("routes").alias("r")).select("file", "shared", "r.*")
    placed = route.join(prefixes(mounts(declared)).hint("merge"), "file", "left").withColumn("full", route_path(F.col("prefix"), F.col("path")))
    first = placed.groupBy("method", F.col("full").alias("path")).agg(F.min_by(F.struct(*[c for c in placed.columns if c not in ("method", "path", "full", "prefix")]), F.struct("file", "place")).alias("r"))
    function = declared.select("path", F.posexplode("functions").alias("n", "f")).groupBy(F.col("f.name").alias("handler"), "path").agg(F.max_by("f.contract", "n").alias("c"))
    known = function.groupBy("handler").agg(F.min_by("c", "path").alias("named"))
    rows = first.select("method", "path", "r.*").join(known.hint("merge"), "handler", "left")
    c = F.coalesce("contract", F.when(F.col("handler") != "anonymous", F.col("named")))
    rows = rows.withColumn("c", c).withColumn("chain", F.concat("shared", "middleware"))
    bare = lambda m: F.regexp_replace(F.lower(m), r"\(\)$", "")
    auth = F.filter("chain", lambda m: bare(m).isin(AUTHENTICATION))
    in_path = F.transform(F.regexp_extract_all("path", F.lit(":([a-zA-Z0-9_]+)"), 1), lambda n: F.struct(n.alias("name"), F.lit("path").alias("place")))
    none = lambda kind: F.array().cast(kind)
    of = lambda name, kind: F.coalesce(F.col(f"c.{name}"), none(kind))
    parameters = F.array_distinct(F.concat(in_path, of("parameters", "array<struct<name: string, place: string>>")))
    statuses = F.when(F.size(of("statuses", "array<int>")) == 0, F.array(F.lit(200))).otherwise(of("statuses", "array<int>"))
    yes = lambda name: F.coalesce(F.col(f"c.{name}"), F.lit(False))
    rows = rows.select(
        "method", "path", "file", "line", "router", "handler", (F.size(auth) > 0).alias("authenticated"), F.exists("chain", lambda m: bare(m).isin(AUTHORIZATION)).alias("authorized"),
        auth.alias("auth_middleware"), F.col("chain").alias("middleware"), parameters.alias("parameters"), of("fields", "array<string>").alias("fields"), statuses.alias("statuses"),
        of("shapes", "array<array<string>>").alias("shapes"), of("downstream", "array<string>").alias("downstream"), *[yes(n).alias(n) for n in ("is_async", "has_try", "database", "external")],
        F.col("c").isNotNull().alias("found"), is_public_route(F.col("path")).alias("is_public"),
    )
    return rows.select(
        "*", completeness(F.col("found"), F.size("parameters")).alias("completeness"), error_coverage(F.col("has_try"), F.col("is_async")).alias("error_coverage"),
        call_depth(F.col("database"), F.col("external"), F.size("downstream") > 0).alias("depth"),
    )
