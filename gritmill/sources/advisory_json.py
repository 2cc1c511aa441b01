"""Advisories as JSON of unknown nesting, read as variants without Python: score, vector, severity and affected versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cvss_base
from ..functions.advisories import canonical_id, severity_of

_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_EVENTS = "array<struct<introduced: string, fixed: string, last_affected: string>>"


def _text(v: Column, path: str) -> Column:
    """A field that is a string, else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    """A field that is a list, else an empty one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def read_advisories(rows: DataFrame, body: str = "body") -> DataFrame:
    """The rows with ``advisory``: a struct of canonical, score, vector, severity, versions, fixed and ranges (with their events).

    The score is a number of the database's own, else that of the first CVSS v3 vector that has one; the vector is the last
    listed one, else the database's. The severity goes by the score, else by the database's word. Versions and fixed
    versions are trimmed and distinct, in order; values of other kinds than expected count as absent. A damaged body is an
    advisory without anything: UNKNOWN. A column ``advisory`` is replaced."""
    parsed = F.coalesce(F.try_parse_json(F.coalesce(F.col(body), F.lit("{}"))), F.parse_json(F.lit("{}")))
    # a text is parsed once, and each vector scored once, as the bound variables of lambdas
    return rows.withColumn("advisory", F.get(F.transform(F.array(parsed), _advisory), F.lit(0)))


def _advisory(v: Column) -> Column:
    own = F.try_variant_get(v, "$.database_specific.cvss.score", "variant")
    number = F.when(F.schema_of_variant(own).rlike(_NUMBER), F.try_variant_get(v, "$.database_specific.cvss.score", "double"))
    listed = F.filter(F.transform(F.filter(_list(v, "$.severity"), lambda s: _text(s, "$.type") == "CVSS_V3"), lambda s: _text(s, "$.score")), lambda x: x.isNotNull())
    stated = _text(v, "$.database_specific.cvss.vectorString")
    # the listed vectors in order, then the database's own, which counts if there is none
    vectors = F.when(F.size(listed) > 0, listed).otherwise(F.filter(F.array(stated), lambda x: x.isNotNull()))
    score = F.coalesce(number, F.get(F.filter(F.transform(vectors, cvss_base), lambda x: x.isNotNull()), F.lit(0)))
    affected = _list(v, "$.affected")
    texts = lambda a, path: F.filter(F.transform(a, lambda x: F.trim(_text(x, path))), lambda x: x.isNotNull())
    versions = F.array_distinct(F.flatten(F.transform(affected, lambda a: texts(_list(a, "$.versions"), "$"))))
    ranges = F.flatten(F.transform(affected, lambda a: _list(a, "$.ranges")))
    event = lambda e: F.struct(_text(e, "$.introduced").alias("introduced"), _text(e, "$.fixed").alias("fixed"), _text(e, "$.last_affected").alias("last_affected"))
    spans = F.transform(ranges, lambda r: F.struct(_text(r, "$.type").alias("type"), F.transform(_list(r, "$.events"), event).cast(_EVENTS).alias("events")))
    fixed = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.filter(texts(_list(r, "$.events"), "$.fixed"), lambda x: x != ""))))
    aliases = F.transform(_list(v, "$.aliases"), lambda x: _text(x, "$"))
    return F.struct(
        canonical_id(_text(v, "$.id"), aliases).alias("canonical"), score.alias("score"), F.try_element_at(vectors, F.lit(-1)).alias("vector"),
        severity_of(F.coalesce(_text(v, "$.database_specific.severity"), F.lit("")), score).alias("severity"), versions.alias("versions"), fixed.alias("fixed"), spans.alias("ranges"),
    )
