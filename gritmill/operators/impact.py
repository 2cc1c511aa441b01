"""What a diff touches: the entities of its files before and after, their change, and how many changed lines are their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_RANGES = "array<struct<start: int, end: int>>"
_ENTITY = "struct<type: string, name: string, start: int, end: int, change: string, ranges: array<struct<start: int, end: int>>>"


def innermost(entities: list[tuple[int, int]], lines: np.ndarray) -> list[int]:
    """How many of the lines have each entity (start, end) as their innermost one. A sweep over starts with a stack of what
    is open gives each entity its parent; a line climbs from the last entity that starts before it to one that reaches it. Of
    equal entities the later is the inner one."""
    order = sorted(range(len(entities)), key=lambda k: (entities[k][0], -entities[k][1], k))
    parent, stack, own = {}, [], [0] * len(entities)
    for k in order:
        while stack and entities[stack[-1]][1] < entities[k][0]:
            stack.pop()
        parent[k] = stack[-1] if stack else None
        stack.append(k)
    starts = np.array([entities[k][0] for k in order], np.int64)
    for line, at in zip(lines.tolist(), (np.searchsorted(starts, lines, "right") - 1).tolist()):
        k = order[at] if at >= 0 else None
        while k is not None and entities[k][1] < line:
            k = parent[k]
        if k is not None:
            own[k] += 1
    return own


def _own_lines(batches):
    for batch in batches:
        out = []
        for row in batch.select(["entities", "new_ranges", "old_ranges"]).to_pylist():
            own = [0] * len(row["entities"])
            for side, ranges in (((lambda e: e["change"] != "DELETED"), row["new_ranges"]), ((lambda e: e["change"] == "DELETED"), row["old_ranges"])):
                at = [k for k, e in enumerate(row["entities"]) if side(e)]
                lines = np.concatenate([np.arange(r["start"], r["end"] + 1) for r in ranges] or [np.zeros(0, np.int64)])
                for k, n in zip(at, innermost([(row["entities"][k]["start"], row["entities"][k]["end"]) for k in at], lines)):
                    own[k] = n
            out.append(own)
        keep = [c for c in batch.schema.names if c not in ("new_ranges", "old_ranges")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.int32()))], names=[*keep, "own"])


def impact(files: DataFrame, new_ranges: DataFrame, old_ranges: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """(diff_id, file_no, file_path, type, name, start, end, change, ranges, own_lines): the entities of each file of a diff.

    files, new_ranges and old_ranges are those of :mod:`diffs`; base and head have diff_id, path, line_count and symbols
    (type, name, start, end; the first is the file) before and after. All entities of an added file are ADDED, of a deleted one
    DELETED. Else entities are matched by type and name: without a match before they are ADDED, with one MODIFIED or
    UNCHANGED as a changed line falls into them or not, and those without a match after are DELETED. ranges are the changed
    ranges that an entity overlaps, own_lines counts changed lines of which it is the innermost entity: in the new file, for
    DELETED entities in the old one. A file without symbols on a side has none there; null paths match nothing."""
    sides = lambda df, path: df.select(F.col("diff_id"), F.col("path").alias(path), F.col("line_count"), F.filter("symbols", lambda s: s["type"] != "FILE").alias("symbols"))
    ranges = lambda df, name: df.groupBy("diff_id", "file_no").agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("int").alias("start"), F.col("last").cast("int").alias("end")))).alias(name))
    old, new = (sides(df, p).select("diff_id", p, F.col("line_count").alias(f"{n}_count"), F.col("symbols").alias(n)) for df, p, n in ((base, "old_path", "base"), (head, "new_path", "head")))
    # all sides grow with the diffs: none is to be broadcast
    rows = files.join(ranges(new_ranges, "new_ranges").hint("merge"), ["diff_id", "file_no"], "left").join(ranges(old_ranges, "old_ranges").hint("merge"), ["diff_id", "file_no"], "left")
    rows = rows.join(old.hint("merge"), ["diff_id", "old_path"], "left").join(new.hint("merge"), ["diff_id", "new_path"], "left")
    none = F.array().cast("array<struct<type: string, name: string, start: int, end: int>>")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(_RANGES))
    has_base, has_head = F.col("base").isNotNull(), F.col("head").isNotNull()
    added = (F.col("change_type") == "added") | (has_head & ~has_base & (F.col("old_path") == "/dev/null"))
    deleted = ~added & ((F.col("change_type") == "deleted") | (has_base & ~has_head & (F.col("new_path") == "/dev/null")))
    rows = rows.select(
        "diff_id", "file_no", F.when(deleted, "DELETED").when(added, "ADDED").alias("whole"),
        F.when(deleted, F.coalesce("old_path", "file_path")).otherwise(F.coalesce("new_path", "file_path")).alias("file_path"), F.coalesce("old_path", "file_path").alias("old_path"),
        F.when(deleted, F.coalesce("base_count", F.lit(1))).when(added, F.coalesce("head_count", F.lit(1))).otherwise(F.coalesce("head_count", "base_count", F.lit(1))).alias("line_count"),
        F.coalesce("base", none).alias("base"), F.coalesce("head", none).alias("head"), listed("new_ranges").alias("new_ranges"), listed("old_ranges").alias("old_ranges"),
    )
    key = lambda s: F.concat(s["type"], F.lit(":"), s["name"])
    met = lambda s, side: F.filter(side, lambda r: F.greatest(s["start"], r["start"]) <= F.least(s["end"], r["end"]))

    def entity(s: Column, change: Column, of: Column) -> Column:
        return F.struct(s["type"].alias("type"), s["name"].alias("name"), s["start"].alias("start"), s["end"].alias("end"), change.alias("change"), of.alias("ranges")).cast(_ENTITY)

    of_head = lambda s: F.when(~F.array_contains(F.transform("base", key), key(s)), "ADDED").when(F.size(met(s, "new_ranges")) > 0, "MODIFIED").otherwise("UNCHANGED")
    changed = (F.size("new_ranges") > 0) | (F.size("old_ranges") > 0)
    whole_ranges = F.when(F.col("whole") == "DELETED", F.col("old_ranges")).otherwise(F.col("new_ranges"))
    file = F.struct(
        F.lit("FILE").alias("type"), F.col("file_path").alias("name"), F.lit(1).alias("start"), F.col("line_count").cast("int").alias("end"),
        F.coalesce("whole", F.when(changed, "MODIFIED").otherwise("UNCHANGED")).alias("change"), whole_ranges.alias("ranges"),
    ).cast(_ENTITY)
    gone = F.filter("base", lambda s: ~F.array_contains(F.transform("head", key), key(s)))
    parts = (
        F.when(F.col("whole") == "ADDED", F.transform("head", lambda s: entity(s, F.lit("ADDED"), F.col("new_ranges"))))
        .when(F.col("whole") == "DELETED", F.transform("base", lambda s: entity(s, F.lit("DELETED"), F.col("old_ranges"))))
        .otherwise(F.concat(F.transform("head", lambda s: entity(s, of_head(s), met(s, "new_ranges"))), F.transform(gone, lambda s: entity(s, F.lit("DELETED"), met(s, "old_ranges")))))
    )
    rows = rows.select("diff_id", "file_no", "file_path", "old_path", "whole", F.concat(F.array(file), parts).alias("entities"), "new_ranges", "old_ranges")
    ship(files.sparkSession)
    kind = files.schema["diff_id"].dataType.simpleString(), files.schema["file_no"].dataType.simpleString()
    swept = rows.mapInArrow(_own_lines, f"diff_id {kind[0]}, file_no {kind[1]}, file_path string, old_path string, whole string, entities array<{_ENTITY}>, own array<int>")
    each = swept.select("*", F.explode(F.arrays_zip("entities", "own")).alias("e"))
    path = F.when((F.col("e.entities.change") == "DELETED") & F.col("whole").isNull(), F.col("old_path")).otherwise(F.col("file_path"))
    return each.select("diff_id", "file_no", path.alias("file_path"), *[F.col(f"e.entities.{c}").alias(c) for c in ("type", "name", "start", "end", "change", "ranges")], F.col("e.own").alias("own_lines"))
