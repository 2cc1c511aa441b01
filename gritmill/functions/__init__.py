"""Pure column functions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points that a finding of each severity costs.
SEVERITY_POINTS = {"CRITICAL": 20, "HIGH": 10, "MEDIUM": 5, "LOW": 1}
#: Order of severities.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pct_delta(previous: Column, current: Column) -> Column:
    """Change in percent: 0 for nothing to nothing, +-100 from nothing, nulls count as 0."""
    p, c = F.coalesce(previous, F.lit(0)), F.coalesce(current, F.lit(0))
    from_zero = F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c.cast("double")) * 100)
    return F.when(p == 0, from_zero).otherwise(F.try_divide((c - p) * 100.0, F.abs(p)))


def ranked(col: Column, ranks: dict[str, int], other: int = 0) -> Column:
    out = F.lit(None)
    for k, v in ranks.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(other)).cast("int")


def posture_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    p = SEVERITY_POINTS
    return clamp(round_half_up(F.lit(100) - (critical * p["CRITICAL"] + high * p["HIGH"] + medium * p["MEDIUM"] + low * p["LOW"])), 0, 100).cast("long")


def version_key(version: Column) -> Column:
    """Dotted numeric versions as arrays that compare in version order; missing parts are 0, a leading v and anything
    after the first - or + are ignored."""
    core = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(core, r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    # missing parts are 0 and zeros at the end say nothing, so arrays of any length compare
    used = F.array_max(F.transform(parts, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return F.slice(parts, 1, used)


def logistic(logit: Column, a: float = -1.0, b: float = 0.0) -> Column:
    """1 / (1 + exp(a * logit + b))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit * a + b))


#: Fixed values of the public CVSS v3.1 specification: weights of the metric values.
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR changed": {"N": 0.85, "L": 0.68, "H": 0.5},
    "CIA": {"N": 0.0, "L": 0.22, "H": 0.56},
}


def cvss_base(vector: Column) -> Column:
    """The CVSS v3.0/3.1 base score of a vector string; null for null, other versions and vectors without a valid AV,
    AC, PR or UI. Missing or unknown C, I and A count as none, a missing scope as unchanged."""
    metrics = F.str_to_map(F.upper(vector), F.lit("/"), F.lit(":"))

    def weight(name: str, table: str) -> Column:
        out = F.lit(None).cast("double")
        for k, v in CVSS_WEIGHTS[table].items():
            out = F.when(metrics[name] == k, F.lit(v)).otherwise(out)
        return out

    changed = F.coalesce(metrics["S"] == "C", F.lit(False))
    safe = F.lit(1.0)
    for name in ("C", "I", "A"):
        safe = safe * (1 - F.coalesce(weight(name, "CIA"), F.lit(0.0)))
    iss = 1 - safe
    pr = F.when(changed, weight("PR", "PR changed")).otherwise(weight("PR", "PR"))
    exploit = 8.22 * weight("AV", "AV") * weight("AC", "AC") * pr * weight("UI", "UI")
    wide = 1.08 * (7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15) + exploit)
    raw = F.when(iss <= 0, F.lit(0.0)).otherwise(F.least(F.lit(10.0), F.when(changed, wide).otherwise(6.42 * iss + exploit)))
    known = F.upper(vector).rlike(r"CVSS:3\.[01]/") & exploit.isNotNull()  # greatest and least skip nulls
    return F.when(known, F.greatest(F.lit(0.0), F.ceil(F.round(raw * 100000) / 10000) / 10))


def risk_class(score: Column, medium: int = 40) -> Column:
    """CRITICAL from 80, HIGH from 60, MEDIUM from ``medium`` (40 for files, 30 for pull requests), else LOW."""
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def file_maintainability(complexity: Column, nesting: Column, smells: Column) -> Column:
    return clamp(round_half_up(100 - 2.5 * complexity - 4 * nesting - 5 * smells), 10, 100).cast("int")


def overview_health(complexity: Column, smells: Column) -> Column:
    return clamp(round_half_up(100 - 2.5 * complexity - 2 * smells), 10, 100).cast("int")


def hash_prefix(parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by line ends."""
    return F.substring(F.sha2(F.array_join(parts, "\n").cast("binary"), 256), 1, length)


def age_seconds(then: Column, now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(then.cast("timestamp")) / 1e6


def kilobytes(size: Column) -> Column:
    """Bytes as kilobytes with one decimal."""
    return F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))


def metric_delta(previous: Column, current: Column) -> Column:
    """struct(previous, current, absoluteDelta to four decimals, percentageDelta to two); nulls count as 0."""
    p, c = F.coalesce(previous, F.lit(0)).cast("double"), F.coalesce(current, F.lit(0)).cast("double")
    return F.struct(p.alias("previous"), c.alias("current"), F.round(c - p, 4).alias("absoluteDelta"), F.round(pct_delta(p, c), 2).alias("percentageDelta"))
