"""Versions, advisories and whether an installed version is affected; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = r"^[\s=v]*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
_LOOSE = r"(?:^|[^\d])(\d{1,16})(?:\.(\d{1,16}))?(?:\.(\d{1,16}))?(?:$|[^\d])"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def package_name(ecosystem: Column, name: Column) -> Column:
    """Lower case without outer space; in PyPI runs of - _ . are one dash. Null becomes empty."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(low, "[-_.]+", "-")).otherwise(low)


def bare_version(specifier: Column, default: str = "1.0.0") -> Column:
    """A version specifier without its leading operators; the default for null or nothing left."""
    v = F.trim(F.regexp_replace(specifier, r"^[\^~>=<]+", ""))
    return F.when(F.coalesce(v, F.lit("")) == "", default).otherwise(v)


def version_text(version: Column) -> Column:
    """major.minor.patch[-prerelease] of a version, or of the first number in the text that looks like one; else null."""
    return _once(version, _text)


def _text(version: Column) -> Column:
    strict = version.rlike(_STRICT)
    pre = F.regexp_extract(version, _STRICT, 4)
    number = lambda pattern, k: F.coalesce(F.regexp_extract(version, pattern, k).try_cast("decimal(20,0)").cast("string"), F.lit("0"))
    whole = F.concat_ws(".", *[number(_STRICT, k) for k in (1, 2, 3)])
    loose = F.concat_ws(".", *[number(_LOOSE, k) for k in (1, 2, 3)])
    return F.when(strict, F.concat(whole, F.when(pre != "", F.concat(F.lit("-"), pre)).otherwise(""))).when(version.rlike(_LOOSE), loose)


def version_order(version: Column) -> Column:
    """A value that compares in the order of semantic versions, prereleases before their release; null if none is found."""
    return _once(version_text(version), _order)


def _order(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"^(\d+)\.(\d+)\.(\d+)", k).cast("decimal(20,0)")
    pre = F.regexp_extract(text, r"^[^-]*-(.*)$", 1)
    ids = F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct((~x.rlike(r"^\d+$")).alias("word"), F.coalesce(F.when(x.rlike(r"^\d+$"), x).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("text")),
    )
    ids = F.when(pre == "", F.slice(ids, 1, 0)).otherwise(ids)
    return F.when(text.isNotNull(), F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), (pre == "").alias("release"), ids.alias("pre")))


def version_change(old: Column, new: Column) -> Column:
    """ADDED, REMOVED, UNCHANGED, UPGRADED, DOWNGRADED; unequal texts that compare alike or not at all are UPDATED."""
    def told(p):
        a, b = p["a"], p["b"]
        return F.when(old.isNull() & new.isNull(), None).when(old.isNull(), "ADDED").when(new.isNull(), "REMOVED").when(old == new, "UNCHANGED").when(b > a, "UPGRADED").when(b < a, "DOWNGRADED").otherwise("UPDATED")

    return _once(F.struct(version_order(old).alias("a"), version_order(new).alias("b")), told)


def severity_of(text: Column, score: Column) -> Column:
    """By score (9, 7, 4, above 0), else by the text; MODERATE is MEDIUM, all else UNKNOWN."""
    s = F.upper(F.trim(text))
    by_text = F.when(s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), s).when(s == "MODERATE", "MEDIUM").otherwise("UNKNOWN")
    known = score.isNotNull() & ~F.isnan(score.cast("double"))
    return F.when(known & (score >= 9), "CRITICAL").when(known & (score >= 7), "HIGH").when(known & (score >= 4), "MEDIUM").when(known & (score > 0), "LOW").otherwise(by_text)


def alert_severity(text: Column) -> Column:
    """Severities of alerts: what is not known counts as MEDIUM."""
    s = F.upper(F.trim(text))
    return F.when(s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), s).otherwise("MEDIUM")


def canonical_id(id_: Column, aliases: Column) -> Column:
    """The least CVE id in capitals, else the least GHSA id, else the id, else UNKNOWN."""
    own = F.trim(F.coalesce(id_, F.lit("")))
    ids = F.concat(F.array(own), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))))
    cve = F.array_min(F.transform(F.filter(ids, lambda x: x.rlike(r"(?i)^CVE-\d{4}-\d+")), F.upper))
    ghsa = F.array_min(F.filter(ids, lambda x: x.rlike(r"(?i)^GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}")))
    return F.coalesce(cve, ghsa, F.when(own != "", own), F.lit("UNKNOWN"))


_SPAN = "struct<introduced: string, fixed: string, last: string>"


def spans_of(events: Column) -> Column:
    """Intervals of an advisory's events (introduced, fixed, last_affected): each introduction opens one, and the next
    event closes it; one that is never closed has no upper end. Events before the first introduction count for nothing."""
    none = F.lit(None).cast("string")
    span = lambda a, b, c: F.array(F.struct(a.alias("introduced"), b.alias("fixed"), c.alias("last")))
    start = F.struct(none.alias("open"), F.array().cast(f"array<{_SPAN}>").alias("done"))

    def step(acc, ev):
        left = F.when(acc["open"].isNotNull(), F.concat(acc["done"], span(acc["open"], none, none))).otherwise(acc["done"])
        closed = F.concat(acc["done"], span(acc["open"], ev["fixed"], F.when(ev["fixed"].isNull(), ev["last_affected"])))
        shut = acc["open"].isNotNull() & (ev["fixed"].isNotNull() | ev["last_affected"].isNotNull())
        return F.when(ev["introduced"].isNotNull(), F.struct(ev["introduced"].alias("open"), left.alias("done"))).when(shut, F.struct(none.alias("open"), closed.alias("done"))).otherwise(acc)

    return F.aggregate(events, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], span(acc["open"], none, none))).otherwise(acc["done"]))


def is_affected(installed: Column, versions: Column, ranges: Column) -> Column:
    """Whether an installed version is affected: named in ``versions``, or within a span of ``ranges`` (array of structs
    with ``events``). Without either list every version is affected; a version that can't be read is in no range; a bound
    that can't be read bounds nothing; ranges without a span decide nothing."""
    spans = F.flatten(F.transform(F.filter(ranges, lambda r: F.coalesce(F.size(r["events"]), F.lit(0)) > 0), lambda r: spans_of(r["events"])))
    has_versions, has_ranges = F.coalesce(F.size(versions), F.lit(0)) > 0, F.coalesce(F.size(ranges), F.lit(0)) > 0

    def decided(x):
        v, text, spans = x["v"], x["text"], x["spans"]
        named = F.coalesce(F.array_contains(versions, installed) | F.coalesce(F.array_contains(versions, text), F.lit(False)), F.lit(False))

        def inside(o):
            above = F.coalesce(v >= o["low"], F.lit(True))
            below = F.when(o["high"].isNotNull(), v < o["high"]).when(o["last"].isNotNull(), v <= o["last"]).otherwise(F.lit(True))
            return above & below

        bounds = lambda s: F.struct(version_order(s["introduced"]).alias("low"), version_order(s["fixed"]).alias("high"), version_order(s["last"]).alias("last"))
        within = F.coalesce(F.exists(spans, lambda s: _once(bounds(s), inside)), F.lit(False))
        return (
            F.when(installed.isNull() | (installed == ""), F.lit(False))
            .when(has_versions & named, F.lit(True))
            .when(has_ranges & v.isNull(), F.lit(False))
            .when(has_ranges & (F.size(spans) > 0), within)
            .when(has_versions & ~has_ranges, F.lit(False))
            .otherwise(F.lit(True))
        )

    return _once(F.struct(version_order(installed).alias("v"), version_text(installed).alias("text"), spans.alias("spans")), decided)


def fixed_target(fixed: Column, installed: Column) -> Column:
    """The lowest fixed version above the installed one, else the highest fixed one; null without any."""
    pairs = F.array_sort(F.filter(F.transform(fixed, lambda x: F.struct(version_order(x).alias("k"), version_text(x).alias("t"))), lambda p: p["k"].isNotNull()))

    def chosen(x):
        above = F.filter(x["pairs"], lambda p: F.coalesce(p["k"] > x["v"], F.lit(True)))
        return F.coalesce(F.get(above, F.lit(0))["t"], F.get(x["pairs"], F.size(x["pairs"]) - 1)["t"])

    return _once(F.struct(pairs.alias("pairs"), version_order(installed).alias("v")), chosen)


def remediation(fixed: Column, installed: Column, name: Column) -> Column:
    return _once(fixed_target(fixed, installed), lambda target: F.when(target.isNotNull(), F.concat(F.lit("Upgrade "), name, F.lit(" to version "), target, F.lit(" or later."))).otherwise(
        F.concat(F.lit("No official fixed version currently available for "), name, F.lit(". Review advisory details for mitigation."))
    ))


def queryable(version: Column) -> Column:
    """Whether a version can be looked up: neither empty nor a git or http address."""
    return F.coalesce((version != "") & ~version.startswith("git") & ~version.startswith("http"), F.lit(False))


def references_of(references: Column) -> Column:
    """References (type, url) with an address; WEB is the type of those without one."""
    kept = F.filter(references, lambda r: F.coalesce(r["url"] != "", F.lit(False)))
    return F.transform(kept, lambda r: F.struct(F.coalesce(F.when(r["type"] != "", r["type"]), F.lit("WEB")).alias("type"), r["url"].alias("url")))
