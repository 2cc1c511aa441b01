"""What must hold on large tables: no side of a join that grows with the rows is broadcast."""

import contextlib

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gritmill.functions import advisories
from gritmill.plans import code, core, functions, repository  # noqa: F401
from gritmill.sources import javascript


@contextlib.contextmanager
def broadcasting(spark):
    """Broadcasts whatever may be."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["relationship_kinds", "diff_impact", "token_clones", "route_discovery"])
def test_broadcasts_nothing(spark, name):
    with broadcasting(spark):
        p = plan(core.QUERIES[name](spark, DATA))
    assert "SortMergeJoin" in p and "Broadcast" not in p


def test_a_version_is_read_once(spark):
    """Its text is matched by a few patterns, not by some for each place that names the result."""
    df = spark.createDataFrame([(["10.0.0", "5.1"], "2.0.0")], "fixed array<string>, installed string")
    said = df.select(advisories.remediation(F.col("fixed"), F.col("installed"), F.lit("lib")).alias("r"))
    assert said.first().r == "Upgrade lib to version 5.1.0 or later."
    assert said._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 50


def test_equal_texts_are_parsed_once():
    texts = ["function f(a) { return g(a) }", "class C extends D { run() { if (this.x) k() } }", "f(("]
    files = [(f"src/{i}.{'ts' if i % 5 == 0 else 'js'}", texts[i % 3]) for i in range(3000)] + [(None, None), ("x.js", "")]
    parsed = []

    def parse(path, text):
        parsed.append(text)
        return javascript.outline(path, text)

    arrow = pa.schema([
        ("path", pa.string()), ("line_count", pa.int32()), ("status", pa.string()), ("symbols", pa.list_(pa.struct([("type", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),),
    ])
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*files)], names=["path", "content"])
    got = [r for b in javascript.remembering(parse, javascript._has_elements, arrow, javascript._named)([batch, batch.slice(0, 0), batch]) for r in b.to_pylist()]
    want = [{k: javascript.outline(*f)[k] for k in arrow.names} for f in files]
    assert got == want * 2
    assert len(parsed) == 8  # three texts in two kinds of files, no text, an empty one
