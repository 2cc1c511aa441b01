"""Alerts: rules over snapshots and changes, their lifecycle, and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SEVERITY_RANK, ranked
from ..functions.advisories import alert_severity

#: The status that each action leaves an alert in; other actions leave it as it is.
STATUS_AFTER = {"CREATED": "OPEN", "ACKNOWLEDGED": "ACKNOWLEDGED", "RESOLVED": "RESOLVED", "DISMISSED": "DISMISSED", "REOPENED": "OPEN"}


def vulnerability_alerts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, severity, dedup_key) of findings (canonical, package, severity) that are critical or high."""
    s = alert_severity(F.col("severity"))
    rule = F.when(s == "CRITICAL", "SEC_CRITICAL_VULNERABILITY").otherwise("SEC_HIGH_VULNERABILITY")
    return findings.where(F.col("severity").isin("CRITICAL", "HIGH")).select(*keys, rule.alias("rule"), s.alias("severity"), F.concat(F.lit("SEC:"), "canonical", F.lit(":"), "package").alias("dedup_key"))


def endpoint_alerts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, severity, dedup_key) of endpoint findings (rule, category, method, path): missing protection, and the
    two older names of unhandled errors."""
    auth = (F.col("category") == "SECURITY") | F.col("rule").isin("AUTH_MISSING", "SECURITY_MISSING_AUTH")
    errors = F.col("rule").isin("ASYNC_NO_TRY_CATCH", "ERROR_HANDLING_INCOMPLETE")
    name = F.when(auth, "API_MISSING_AUTH").when(errors, "API_UNHANDLED_ASYNC")
    front = F.when(auth, "API_AUTH:").otherwise("API_ASYNC:")
    return findings.select(*keys, name.alias("rule"), F.lit("HIGH").alias("severity"), F.concat(front, "method", F.lit(":"), "path").alias("dedup_key")).where("rule is not null")


def snapshot_alerts(snapshots: DataFrame, id_col: str) -> DataFrame:
    """(id, rule, severity, dedup_key) of snapshots with security_score, api_score and duplication_ratio: below 70, below 70
    and above 0.30. Null values raise nothing."""
    id_ = F.col(id_col).cast("string")
    rules = [("SEC_SCORE_LOW", F.col("security_score") < 70, "SEC_SCORE_LOW:"), ("API_SCORE_DROP", F.col("api_score") < 70, "API_SCORE_DROP:"), ("CODE_DUPLICATION_SPIKE", F.col("duplication_ratio") > 0.30, "DUP_SPIKE:")]
    hits = [F.when(c, F.struct(F.lit(n).alias("rule"), F.lit("HIGH").alias("severity"), F.concat(F.lit(k), id_).alias("dedup_key"))) for n, c, k in rules]
    return snapshots.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("a")).select(id_col, "a.*")


def change_alerts(changes: DataFrame, number: str = "number") -> DataFrame:
    """(number, rule, severity, dedup_key): the first of blocked, critical and high that holds of a change with gate and
    category; other changes have no row."""
    rule = F.when(F.col("gate") == "BLOCKED", "PR_BLOCKED").when(F.col("category") == "CRITICAL", "PR_CRITICAL_RISK").when(F.col("category") == "HIGH", "PR_HIGH_RISK")
    key = F.concat(F.when(F.col("rule") == "PR_BLOCKED", "PR_BLOCKED:").when(F.col("rule") == "PR_CRITICAL_RISK", "PR_CRITICAL:").otherwise("PR_HIGH:"), F.col(number).cast("string"))
    return changes.select(number, rule.alias("rule")).where("rule is not null").select(number, "rule", F.when(F.col("rule") == "PR_HIGH_RISK", "HIGH").otherwise("CRITICAL").alias("severity"), key.alias("dedup_key"))


def auto_resolved(open_alerts: DataFrame, present: DataFrame) -> DataFrame:
    """Open or acknowledged alerts with a key of a vulnerability, or of missing protection, that no present key backs."""
    mine = F.col("dedup_key").startswith("SEC:") | (F.col("rule") == "API_MISSING_AUTH")
    return open_alerts.where(F.col("status").isin("OPEN", "ACKNOWLEDGED") & mine).join(present.select("dedup_key").distinct(), "dedup_key", "left_anti")


def lifecycle(activities: DataFrame, alert: str, action: str, order: list[str]) -> DataFrame:
    """(alert, status, acknowledged_at, resolved_at, dismissed_at, steps) folded from the trail of actions, the last by
    ``order`` (a unique order; its first column is the time). Reopening clears the times of resolving and dismissing; comments and
    assignments change no status; an alert without any of these actions is OPEN. Null actions count as steps only."""
    time, last = F.col(order[0]), F.struct(*order)
    at = lambda name: F.max(F.when(F.col(action) == name, last))
    deciding = F.col(action).isin(list(STATUS_AFTER))
    g = activities.groupBy(alert).agg(
        F.max_by(F.when(deciding, F.col(action)), F.when(deciding, last)).alias("a"), *[at(n).alias(n) for n in ("ACKNOWLEDGED", "RESOLVED", "DISMISSED", "REOPENED")], F.count("*").alias("steps")
    )
    status = F.lit("OPEN")
    for name, s in STATUS_AFTER.items():
        status = F.when(F.col("a") == name, s).otherwise(status)
    since = lambda name: F.when(F.col("REOPENED").isNull() | (F.col(name) > F.col("REOPENED")), F.col(name)[order[0]])
    return g.select(alert, status.alias("status"), F.col("ACKNOWLEDGED")[order[0]].alias("acknowledged_at"), since("RESOLVED").alias("resolved_at"), since("DISMISSED").alias("dismissed_at"), "steps")


def eligible(severity: Column, least: Column, in_app: Column, email: Column, category_on: Column) -> Column:
    """Whether a user is told: a channel is on, the severity is at least the wanted one, and the category isn't off."""
    weight = lambda c: ranked(F.upper(c), SEVERITY_RANK)
    yes = lambda c, d: F.coalesce(c, F.lit(d))
    return (yes(in_app, False) | yes(email, False)) & (weight(severity) >= weight(least)) & yes(category_on, True)


def notifications(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, status) of eligible alerts joined with their user's in_app and email: within the application they
    are delivered, by mail they fail, as no gateway is set up."""
    told = [F.when(F.col("in_app"), F.struct(F.lit("in_app").alias("channel"), F.lit("DELIVERED").alias("status"))), F.when(F.col("email"), F.struct(F.lit("email").alias("channel"), F.lit("FAILED").alias("status")))]
    return alerts.select(*keys, F.explode(F.array_compact(F.array(*told))).alias("n")).select(*keys, "n.*")
