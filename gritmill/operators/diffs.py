"""Unified diffs as relations: each diff's lines by one pass over its text, files and hunks by grouping, ranges by islands."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import git_path
from ..shipping import ship
from .intervals import compress

# The header of a hunk, and what lines between hunks begin with.
_HUNK = r"^@@\s+-([0-9]+)(?:,([0-9]+))?\s+\+([0-9]+)(?:,([0-9]+))?\s+@@(?:\s+(.*))?$"
_HEAD = r"(diff --git |new file mode |deleted file mode |rename (from|to) |copy (from|to) |Binary files .*differ|GIT binary patch|--- |\+\+\+ )"
_KINDS = {"+": "add", "-": "del", " ": "context", "\\": "mark"}
#: Characters of the diffs whose lines a task remembers at most.
REMEMBERED = 4_000_000
_hunk, _head = re.compile(_HUNK, re.ASCII), re.compile(_HEAD)


def read_lines(text: str):
    """(line_no, file_no, hunk_no, kind, old_line, new_line, line) of one diff's lines from its first header on."""
    lines = re.split(r"\r?\n", text)
    git = False  # whether a git header came before
    file_no = hunk_no = old = new = old_left = new_left = 0
    inside = False
    for i, line in enumerate(lines):
        opens = line.startswith("diff --git ")
        if not file_no and not git and not opens:
            opens = line.startswith("--- ")  # a diff without git's headers begins with its first old path
        git |= line.startswith("diff --git ")
        if opens:
            file_no, hunk_no, inside, old_left, new_left = file_no + 1, 0, False, 0, 0
        if not file_no:
            continue
        # a deleted line -- x looks like a header; it is one if the hunk has all its lines, or a new hunk follows too early
        content = inside and line[:1] in "+-" and (old_left if line[:1] == "-" else new_left) > 0
        if content and line.startswith("--- ") and (old_left, new_left) != (1, 1):
            content = not (lines[i + 1 : i + 2] and lines[i + 1].startswith("+++ ") and lines[i + 2 : i + 3] and lines[i + 2].startswith("@@ "))
        old_line = new_line = None
        if opens or (_head.match(line) and not content):
            kind = "head"
            if line.startswith("--- "):
                old_left = new_left = 0
        elif line.startswith("@@ "):
            m = _hunk.match(line)
            kind, inside = ("hunk", True) if m else ("malformed", False)
            if m:
                hunk_no += 1
                old, new = int(m[1]), int(m[3])
                old_left, new_left = (1 if m[k] is None else int(m[k]) for k in (2, 4))
        elif inside and line[:1] in _KINDS:
            kind = _KINDS[line[0]]
            if kind in ("del", "context"):
                old_line, old, old_left = old, old + 1, old_left - 1
            if kind in ("add", "context"):
                new_line, new, new_left = new, new + 1, new_left - 1
        else:
            kind = "other"
        yield i, file_no, hunk_no, kind, old_line, new_line, line


def diff_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """(diff_id, line_no, file_no, hunk_no, kind, old_line, new_line, line) of all lines of all diffs, without a shuffle.

    ``kind`` is add, del, context or mark within a hunk, and head, hunk, malformed or other elsewhere; old_line and
    new_line are the line's places in the old and the new file. As long as a hunk lacks lines of its header's counts, a line
    that looks like a file's header is one of its lines. Diffs of equal texts are read once as long as a task remembers them. A malformed header ends the hunk before it. Null and blank diffs
    have no lines; equal ids of several diffs must be made distinct before."""
    rows = diffs.select(F.col(id_col).alias("diff_id"), F.col(text_col).alias("t")).where(F.trim("t") != "")
    kind = diffs.schema[id_col].dataType.simpleString()
    names = ["line_no", "file_no", "hunk_no", "kind", "old_line", "new_line", "line"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def lined(pending, known):
        texts = {t: None for _, t in pending if t not in known["at"]}
        if texts:
            found = []
            for t in texts:
                lines = list(read_lines(t))
                known["at"][t] = known["n"] + len(found), len(lines)
                found += lines
                known["held"] += len(t) + 1000
            new = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(types), types)], names=names)
            known["lines"] = pa.concat_batches([known["lines"], new]) if known["lines"] is not None else new
            known["n"] += len(found)
        start, size = np.array([known["at"][t] for _, t in pending], np.int64).T
        row = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own, of = pa.concat_arrays([i for i, _ in pending]), np.repeat(np.arange(len(pending)), size)
        for first in range(0, len(row), 8192):
            cut = known["lines"].take(pa.array(row[first : first + 8192]))
            yield pa.RecordBatch.from_arrays([own.take(pa.array(of[first : first + 8192])), *cut.columns], names=["diff_id", *names])

    def run(batches):
        known = {"at": {}, "lines": None, "n": 0, "held": 0}
        for batch in batches:
            pending, chars = [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                pending.append((batch.column(0).slice(i, 1), text))
                chars += len(text)
                if len(pending) == 1024 or chars > 1_000_000 or i + 1 == batch.num_rows:
                    yield from lined(pending, known)
                    pending, chars = [], 0
                    if known["held"] > REMEMBERED:
                        known = {"at": {}, "lines": None, "n": 0, "held": 0}

    ship(diffs.sparkSession)
    return rows.mapInArrow(run, f"diff_id {kind}, line_no int, file_no long, hunk_no long, kind string, old_line long, new_line long, line string")


def diff_files(lines: DataFrame) -> DataFrame:
    """A row for each file of :func:`diff_lines`: old_path, new_path, file_path, change_type, is_binary, additions,
    deletions. Later headers win over earlier ones."""
    line = F.col("line")
    after = lambda prefix: F.when(line.startswith(prefix), F.trim(F.expr(f"substring(line, {len(prefix) + 1})")))
    parts = F.split(F.trim(F.substring("line", 12, 1 << 30)), " ")
    git = line.startswith("diff --git ") & (F.size(parts) >= 2)
    old = F.coalesce(F.when(git, git_path(F.get(parts, F.lit(0)))), F.when(line.startswith("new file mode "), "/dev/null"), after("rename from "), after("copy from "), git_path(after("--- ")))
    new = F.coalesce(F.when(git, git_path(F.get(parts, F.lit(1)))), F.when(line.startswith("deleted file mode "), "/dev/null"), after("rename to "), after("copy to "), git_path(after("+++ ")))
    change = F.when(line.startswith("new file mode "), "added").when(line.startswith("deleted file mode "), "deleted").when(line.rlike("^rename (from|to) "), "renamed").when(line.rlike("^copy (from|to) "), "copied")
    binary = line.rlike("^Binary files .*differ|^GIT binary patch")
    last = lambda x: F.max_by(F.when(F.col("kind") == "head", x), F.when((F.col("kind") == "head") & x.isNotNull(), F.col("line_no")))
    g = lines.groupBy("diff_id", "file_no").agg(
        last(old).alias("old_path"), last(new).alias("new_path"), last(change).alias("stated"), F.bool_or((F.col("kind") == "head") & binary).alias("is_binary"),
        F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"),
    )
    change_type = F.coalesce("stated", F.when(F.col("old_path") == "/dev/null", "added").when(F.col("new_path") == "/dev/null", "deleted").when(F.col("old_path") != F.col("new_path"), "renamed").otherwise("modified"))
    path = F.when(F.col("new_path") != "/dev/null", F.col("new_path")).otherwise(F.col("old_path"))
    return g.select("diff_id", "file_no", "old_path", "new_path", path.alias("file_path"), change_type.alias("change_type"), "is_binary", "additions", "deletions")


def diff_hunks(lines: DataFrame) -> DataFrame:
    """A row for each hunk: starts, counts (1 where none is stated), heading, additions, deletions."""
    part = lambda k: F.max(F.when(F.col("kind") == "hunk", F.regexp_extract("line", _HUNK, k)))
    count = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(1))
    return lines.where("hunk_no > 0").groupBy("diff_id", "file_no", "hunk_no").agg(
        part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"), F.trim(part(5)).alias("heading"),
        F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions"),
    )


def changed_ranges(lines: DataFrame, side: str = "new") -> DataFrame:
    """Ranges of consecutive changed lines: added ones in the new file, or deleted ones in the old file."""
    kind = "add" if side == "new" else "del"
    return compress(lines.where(F.col("kind") == kind), ["diff_id", "file_no"], f"{side}_line")


def diff_warnings(lines: DataFrame) -> DataFrame:
    """Malformed hunk headers, and lines within a hunk that belong to no kind."""
    bad = (F.col("kind") == "malformed") | ((F.col("kind") == "other") & (F.col("hunk_no") > 0))
    return lines.where(bad).select("diff_id", (F.col("line_no") + 1).alias("line_no"), F.when(F.col("kind") == "malformed", "malformed hunk header").otherwise("unexpected line").alias("warning"), "line")
