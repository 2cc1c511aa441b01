"""Bounded, deterministic samples of labelled rows for the classifiers, which are trained on the driver or in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tune

#: Rows that a sample has at most, about, and characters of text; texts are drawn whole or not at all.
SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 8 << 20
#: A longer text takes no part in a sample, as it would fill it alone. It is scored whole like any other.
LONGEST = SAMPLE_CHARS // 4


def _part(seed: str, *columns: str):
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _ordered(found: list[tuple]) -> list[tuple]:
    """(text, label) of rows (id, label, text) in a fixed order."""
    return [(text, label) for _, label, text in sorted(found, key=lambda r: (str(r[0]), str(r[1]), r[2]))]


def _in_task(rows: DataFrame, use: Callable):
    """What ``use`` makes of the sample in one task; the texts don't reach the driver."""

    def run(batches):
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(use(_ordered(found)))], pa.binary())], names=["made"])

    made = rows.coalesce(1).mapInArrow(run, "made binary").first()
    return pickle.loads(made[0]) if made else use([])


def sample_rows(rows: DataFrame, bound: int, seed: str, use: Callable | None = None):
    """At most about ``bound`` distinct rows of each label of ``rows`` (id, text, label): [(whole text, label)], in a fixed order.

    Labels are counted first; rows are drawn by a seeded hash of id and text, so rows that repeat an id are drawn one by
    one, and equal rows count once. With many labels each gets fewer rows, so that SAMPLE_ROWS bounds them all; with long
    texts all labels get fewer by one rate, so that SAMPLE_CHARS does. What is drawn is written before it is measured, so the
    table is read twice. More labels than SAMPLE_ROWS raise a ValueError. With ``use`` the result is what it makes of that
    list, in a task."""
    ws = Workspace(tune(rows.sparkSession), "sample")
    rows = rows.where("text is not null and label is not null").select("id", "text", "label")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(SAMPLE_ROWS + 1).collect()}
    if len(sizes) > SAMPLE_ROWS:
        raise ValueError(f"more than {SAMPLE_ROWS} labels")
    if not sizes:
        return use([]) if use else []
    bound = max(1, min(bound, SAMPLE_ROWS // len(sizes)))
    rates = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, bound / n))])
    drawn = rows.withColumn("part", _part(seed, "id", "text") / F.element_at(rates, F.col("label"))).where((F.col("part") < 1) & (F.length("text") <= LONGEST)).distinct()
    drawn = ws.cut(drawn, "drawn", sum(min(n, bound) for n in sizes.values()), 512)
    chars = drawn.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    drawn = drawn.where(F.col("part") < min(1.0, SAMPLE_CHARS / max(chars, 1))).select("id", "label", "text")
    out = _in_task(drawn, use) if use else _ordered([tuple(r) for r in drawn.collect()])
    ws.close()
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, seed: str, use: Callable | None = None):
    """As :func:`sample_rows` of ``docs`` (id, text) with the labels in ``labels`` (id, label). Ids are drawn first, twice
    as many as rows are wanted, so that what the join broadcasts is bounded whatever the input's size; a label holds for
    every row of its id."""
    known = labels.where("id is not null and label is not null").select("id", "label").distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return use([]) if use else []
    rates = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, 2 * bound / n))])
    chosen = known.where(_part(f"{seed}:id", "id") < F.element_at(rates, F.col("label")))
    return sample_rows(docs.join(F.broadcast(chosen), "id").select("id", "text", "label"), bound, seed, use)
