"""Recorded responses of a service as a data source, for batches and streams, and readers of what they hold.

A recording is a folder of files of JSON lines, each a request with its answers in order: {"request": ..., "answers":
[{"status": 500}, {"status": 200, "body": ...}]}. The source asks as a client does, again after a pause that doubles, and tells
what failed in rows of its own instead of failing. The folder must be mounted where the tasks run.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..shipping import ship

# Requests of a stream's chunk, attempts at one, milliseconds before the second attempt, bytes of a partition, and
# rows of an Arrow batch.
CHUNK, ATTEMPTS, PAUSE, PART, ROWS = 250, 3, 500, 8 << 20, 4096
SCHEMA = "request string, attempts int, status int, body string, error string"
_ARROW = pa.schema([("request", pa.string()), ("attempts", pa.int32()), ("status", pa.int32()), ("body", pa.string()), ("error", pa.string())])


def _files(options) -> list[str]:
    folder = options["path"].removeprefix("file://")
    return sorted(f for f in glob.glob(os.path.join(folder, "*")) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))


def asked(line: str, attempts: int, pause: float) -> tuple:
    """One request: the first answer below 400, or the last one with an error. A damaged line is an error of no request."""
    try:
        entry = json.loads(line)
        answers, request = entry.get("answers") or [], entry.get("request")
    except (ValueError, AttributeError):
        return None, 0, None, None, "damaged recording"
    status = None
    for k in range(attempts):
        if k:
            time.sleep(pause * 2 ** (k - 1) / 1000)
        answer = answers[min(k, len(answers) - 1)] if answers else {}
        status = answer.get("status")
        if status is not None and status < 400:
            return request, k + 1, status, answer.get("body"), None
    return request, attempts, status, None, f"no answer after {attempts} attempts" if status is None else f"status {status} after {attempts} attempts"


class _Chunk(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceReader):
    """A partition for each stretch of a file, which holds the lines that begin in it; the driver asks for the sizes of files
    alone. With a chunk given, a partition for each chunk of requests, whose places the driver reads."""

    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in _files(self.options):
            size = os.path.getsize(file)
            if "chunk" not in self.options:
                out += [_Chunk(file, at, min(at + PART, size)) for at in range(0, size, PART)]
                continue
            with open(file, "rb") as f:
                at = start = n = 0
                for line in f:
                    at, n = at + len(line), n + 1
                    if n % int(self.options["chunk"]) == 0:
                        out.append(_Chunk(file, start, at))
                        start = at
                if at > start:
                    out.append(_Chunk(file, start, at))
        return out

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        attempts, pause = int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("pause", PAUSE))
        lines = (line.rstrip("\r\n") for line in _lines_from(partition) if line.strip())
        while rows := [asked(line, attempts, pause) for line in itertools.islice(lines, ROWS)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _lines_from(part: _Chunk) -> Iterator[str]:
    """The lines that begin in a stretch of a file."""
    with open(part.file, "rb") as f:
        f.seek(max(0, part.start - 1))
        if part.start:
            f.readline()  # the rest of a line that begins before the stretch
        while f.tell() < part.end and (line := f.readline()):
            yield line.decode("utf-8", "replace")


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are a file's place in the order of names and the number of its lines that were read."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"file": 0, "line": 0}

    def _lines(self, start: dict, most: int | None, end: dict | None = None):
        files, at, out = _files(self.options), dict(start), []
        while at["file"] < len(files) and (most is None or len(out) < most) and at != end:
            with open(files[at["file"]], encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
            last = len(lines) if end is None or end["file"] > at["file"] else end["line"]
            part = lines[at["line"] : last][: None if most is None else most - len(out)]
            out += part
            at["line"] += len(part)
            if at["line"] >= len(lines) and at["file"] + 1 < len(files) and at != end:
                at = {"file": at["file"] + 1, "line": 0}
            elif not part or at["line"] >= last:
                break
        return out, at

    def _rows(self, lines: list[str]) -> Iterator[tuple]:
        attempts, pause = int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("pause", PAUSE))
        return iter([asked(line, attempts, pause) for line in lines if line.strip()])

    def read(self, start: dict):
        lines, at = self._lines(start, int(self.options.get("chunk", CHUNK)))
        return self._rows(lines), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(self._lines(start, None, end)[0])


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def recorded(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """(request, attempts, status, body, error) of all requests recorded in a folder; options are chunk (the
    requests of a partition or of a stream's batch), attempts and pause."""
    ship(spark).dataSource.register(Recorded)
    reader = (spark.readStream if stream else spark.read).format("recorded").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def failures(answered: DataFrame) -> DataFrame:
    """The side output: requests without an answer, and why."""
    return answered.where("error is not null").select("request", "attempts", "error")


def blobs(answered: DataFrame, *others: str, failed: bool = False) -> DataFrame:
    """(request, content, line_count, size, and any other columns) of answers {"content": base64}: UTF-8 with LF line ends. An
    empty text has no line; a body without content is an empty text. With ``failed``, requests without an answer have rows of
    nulls."""
    raw = F.regexp_replace(F.coalesce(F.get_json_object("body", "$.content"), F.lit("")), r"\s", "")
    text = F.replace(F.decode(F.unbase64(raw), "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    rows = (answered if failed else answered.where("error is null")).select("request", *others, F.when(F.col("error").isNull(), text).alias("content"))
    lines = F.when(F.col("content") == "", 0).when(F.col("content").isNotNull(), F.size(F.split("content", "\n")))
    return rows.select("request", "content", lines.alias("line_count"), F.octet_length("content").alias("size"), *others)


def trees(answered: DataFrame) -> DataFrame:
    """(request, truncated, path, sha, size) of the blobs of answers {"tree": [...], "truncated": ...}; other entries go."""
    schema = "struct<truncated: boolean, tree: array<struct<path: string, type: string, sha: string, size: long>>>"
    rows = answered.where("error is null").select("request", F.from_json("body", schema).alias("j"))
    entries = rows.select("request", F.coalesce("j.truncated", F.lit(False)).alias("truncated"), F.explode("j.tree").alias("e"))
    return entries.where("e.type = 'blob'").select("request", "truncated", "e.path", "e.sha", "e.size")
