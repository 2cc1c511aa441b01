"""Endpoints of an API: contracts, reliability rules, score, summary and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp

#: Methods that change something.
MUTATIONS = ["POST", "PUT", "DELETE", "PATCH"]
#: Points that a finding of each severity costs.
POINTS = {"HIGH": 12, "MEDIUM": 6, "LOW": 2}


def completeness(found: Column, parameters: Column) -> Column:
    """COMPLETE with parameters, UNKNOWN without a handler, else PARTIAL; null counts as none and as not found."""
    return F.when(F.coalesce(parameters, F.lit(0)) > 0, "COMPLETE").when(~F.coalesce(found, F.lit(False)), "UNKNOWN").otherwise("PARTIAL")


def error_coverage(has_try: Column, is_async: Column) -> Column:
    return F.when(F.coalesce(has_try, F.lit(False)), "IDENTIFIED").when(F.coalesce(is_async, F.lit(False)), "UNIDENTIFIED").otherwise("PARTIAL")


def call_depth(database: Column, external: Column, any_call: Column) -> Column:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.least(F.lit(5), 1 + one(database) + one(external) + one(any_call))


def findings(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, severity, category): a row for each of the eight rules that an endpoint breaks, in one pass.

    Columns: method, path, is_public, authenticated, authorized, is_async, has_try, database, external (booleans, null
    is false), statuses (array of int, null is empty), completeness, depth. Keys may repeat; no endpoints, no rows."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    changes = F.coalesce(F.upper("method").isin(MUTATIONS), F.lit(False))
    statuses = F.coalesce("statuses", F.array().cast("array<int>"))
    has_id = F.coalesce(F.col("path").rlike(":(id|pullNumber)"), F.lit(False))
    rules = [
        ("API_MISSING_AUTH", ~yes("is_public") & ~yes("authenticated"), F.when(changes, "HIGH").otherwise("MEDIUM"), "SECURITY"),
        ("API_MISSING_AUTHORIZATION", yes("authenticated") & ~yes("authorized") & (has_id | changes), F.lit("MEDIUM"), "SECURITY"),
        ("API_UNHANDLED_ASYNC", yes("is_async") & ~yes("has_try"), F.lit("HIGH"), "RELIABILITY"),
        ("API_INCONSISTENT_STATUS", F.array_contains(statuses, 200) & F.exists(statuses, lambda s: (s >= 400) & (s < 500)) & ~yes("has_try"), F.lit("LOW"), "RELIABILITY"),
        ("API_DATABASE_NO_ERROR_HANDLING", yes("database") & ~yes("has_try"), F.lit("HIGH"), "RELIABILITY"),
        ("API_EXTERNAL_DEPENDENCY_EXPOSURE", yes("external") & ~yes("has_try"), F.lit("MEDIUM"), "RELIABILITY"),
        ("API_CONTRACT_INCOMPLETE", F.col("completeness") == "UNKNOWN", F.lit("LOW"), "CONTRACT"),
        ("API_EXCESSIVE_DEPENDENCY_DEPTH", F.col("depth") >= 4, F.lit("LOW"), "PERFORMANCE"),
    ]
    hits = [F.when(c, F.struct(F.lit(n).alias("rule"), s.alias("severity"), F.lit(k).alias("category"))) for n, c, s, k in rules]
    return endpoints.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*keys, "f.*")


def reliability(endpoints: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """(group, endpoints, unauthenticated, unknown, methods, high, medium, low, score) for each group of endpoints.

    methods is a map of counts by method; unauthenticated counts endpoints that are neither public nor authenticated, and
    weighs against those not public. The score is 100 less the findings' points, 15 times the unauthenticated share and
    10 times the unknown share, between 0 and 100, to two decimals; a group without endpoints has no row."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_method = endpoints.groupBy(*group, F.upper("method").alias("method")).agg(
        F.count("*").alias("n"), F.count_if(~yes("is_public")).alias("closed"), F.count_if(~yes("is_public") & ~yes("authenticated")).alias("open"), F.count_if(F.col("completeness") == "UNKNOWN").alias("unknown")
    )
    counts = by_method.groupBy(*group).agg(
        F.sum("n").alias("endpoints"), F.sum("closed").alias("closed"), F.sum("open").alias("unauthenticated"), F.sum("unknown").alias("unknown"),
        F.map_from_entries(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("method", "n")))).alias("methods"),
    )
    severities = found.groupBy(*group).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in POINTS])
    on = [counts[g].eqNullSafe(severities[g]) for g in group]
    joined = counts.join(severities, on, "left").select(*[counts[g] for g in group], "endpoints", "closed", "unauthenticated", "unknown", "methods", *[F.coalesce(s.lower(), F.lit(0)).alias(s.lower()) for s in POINTS])
    cost = sum((F.col(s.lower()) * p for s, p in POINTS.items()), F.lit(0))
    share = F.coalesce(F.try_divide(F.col("unauthenticated"), F.col("closed")), F.lit(0.0)) * 15 + F.col("unknown") / F.col("endpoints") * 10
    return joined.withColumn("score", F.round(clamp(100 - cost - share, 0.0, 100.0), 2)).drop("closed")


def changes(old: DataFrame, new: DataFrame, fields: list[str], keys: list[str] = ("method", "path")) -> DataFrame:
    """(keys, change, changed) of two snapshots: ADDED, REMOVED, MODIFIED or UNCHANGED, and the fields that differ. Null
    keys match null keys; a key that repeats in a snapshot must be made distinct before."""
    a = old.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.struct(*fields).alias("__old"))
    b = new.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.struct(*fields).alias("__new"))
    on = [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in keys]
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), f) for f in fields]))
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    change = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").when(F.size(differ) > 0, "MODIFIED").otherwise("UNCHANGED")
    key = lambda k: F.when(F.col("__old").isNotNull(), F.col(f"__a_{k}")).otherwise(F.col(f"__b_{k}")).alias(k)
    return a.join(b, on, "full").select(*[key(k) for k in keys], change.alias("change"), F.when(both, differ).otherwise(F.array().cast("array<string>")).alias("changed"))
