"""Packing token ids into fixed rows by best-fit decreasing, written as binary matrices.

Ids come as packed integers (a binary column of one integer width). A document longer than a row is split losslessly:
its full pieces are rows of their own and its rest is packed with the others. Pieces are dealt to groups of bounded
size by a seeded hash; in a group, pieces go by falling length to the open row with the least room that still holds
them, found in a segment tree over capacities. Each task writes its matrix (rows x length), cumulative segment lengths
and position resets as .npy files under temporary names; the report of the attempts that succeeded is the manifest, and
only its files get their final names.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, groups_of, remove, scratch, seeded, tune

LENGTH = 8192
#: Bytes of ids that a group holds about; a group is one matrix.
GROUP_BYTES = 16 << 20


class Capacities:
    """A segment tree over capacities 0..length: how many open rows have each; the least one at or above a need."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._step(room, 1)

    def take(self, room: int) -> int:
        self._step(room, -1)
        return self.rows[room].pop()

    def _step(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, need: int) -> int | None:
        """The smallest capacity >= need that an open row has."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit(lengths: list[int], length: int) -> list[int]:
    """The row of each piece (pieces in any order, each at most ``length``); ties go by position."""
    open_, out, rows = Capacities(length), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = open_.least(lengths[k])
        if room is None:
            room, row, rows = length, rows, rows + 1
        else:
            row = open_.take(room)
        out[k] = row
        if room > lengths[k]:
            open_.add(room - lengths[k], row)
    return out


_REPORT = pa.schema([
    ("group", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int64())),
    ("cu_lengths", pa.list_(pa.int64())), ("sha256", pa.string()), ("temporary", pa.string()), ("file", pa.string()),
])
_REPORT_SQL = "`group` long, row long, n_tokens long, ids array<long>, pieces array<long>, cu_lengths array<long>, sha256 string, temporary string, file string"


def _save(at, path: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    with at.open_output_stream(path, compression=None) as f:
        f.write(out.getvalue())


def _pack(root: str, dtype: str, length: int, pad: int):
    def run(batches):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root)
        at.create_dir(f"{base}/_temporary", recursive=True)
        for (group,), t in groups_of(batches, ["group"]):
            ids, piece, data = t.column("id").to_pylist(), t.column("piece").to_pylist(), t.column("data").to_pylist()
            parts = [np.frombuffer(d, dtype) for d in data]
            rows = best_fit([len(p) for p in parts], length)
            n = max(rows) + 1
            matrix, position = np.full((n, length), pad, dtype), np.zeros((n, length), "<u4")
            members: list[list[int]] = [[] for _ in range(n)]
            for k, r in enumerate(rows):
                members[r].append(k)
            ends: list[list[int]] = []
            for r, own in enumerate(members):
                cu = [0]
                for k in own:
                    a, b = cu[-1], cu[-1] + len(parts[k])
                    matrix[r, a:b] = parts[k]
                    position[r, a:b] = np.arange(b - a)
                    cu.append(b)
                ends.append(cu)
            key, name = uuid.uuid4().hex, f"group-{group:06d}"
            _save(at, f"{base}/_temporary/{key}.ids.npy", matrix)
            _save(at, f"{base}/_temporary/{key}.resets.npy", np.argwhere((position == 0) & (np.arange(length) < np.array([c[-1] for c in ends])[:, None])).astype("<u4"))
            _save(at, f"{base}/_temporary/{key}.cu.npy", np.array([x for c in ends for x in c], "<u4"))
            yield pa.RecordBatch.from_pylist(
                [
                    {"group": group, "row": r, "n_tokens": ends[r][-1], "ids": [ids[k] for k in own], "pieces": [piece[k] for k in own], "cu_lengths": ends[r],
                     "sha256": hashlib.sha256(matrix[r].tobytes()).hexdigest(), "temporary": key, "file": name}
                    for r, own in enumerate(members)
                ],
                schema=_REPORT,
            )

    return run


def _commit(root: str):
    def run(batches):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            at.create_dir(f"{base}/data", recursive=True)
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind in ("ids", "resets", "cu"):
                    if at.get_file_info(f"{base}/data/{name}.{kind}.npy").type == fs.FileType.NotFound:
                        at.move(f"{base}/_temporary/{key}.{kind}.npy", f"{base}/data/{name}.{kind}.npy")
            yield batch

    return run


def pack(rows: DataFrame, root: str | None = None, id_col: str = "doc_id", data_col: str = "data", dtype: str = "u1", length: int = LENGTH, pad: int = 255, seed: str = "pack", total: int | None = None) -> DataFrame:
    """Packs all rows' ids and writes them below ``root``; returns a row per packed row: group, row, n_tokens, ids and
    pieces (the documents and pieces in it, in order), cu_lengths, sha256 (of the padded row), file.

    ``data_col`` holds ids packed as ``dtype``. Null and empty data have no tokens and are in no row. Null ids stay as
    null; repeated rows are packed as often as they come. Runs agree for equal tables, as pieces are sorted before they
    are packed. An empty table gives an empty result. ``total`` is about how many bytes of data there are, if that is known:
    then rows go to their groups as they are made and are not written before, and ``data_col`` should be made by a
    function that Spark takes for nondeterministic, so that it runs once."""
    spark = tune(rows.sparkSession)
    root = root or scratch(spark, "packed")
    ws = Workspace(spark, "packing")
    width = np.dtype(dtype).itemsize
    written = rows.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"))
    if total is None:  # ids may come from a Python stage, which should run once: they are written before anything else looks at them
        written = ws.cut(written, "ids")
        total = written.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    plain = written.where(F.octet_length("data") > 0)
    step = length * width
    groups = max(1, -(-total // GROUP_BYTES))
    cut = plain.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("data") - 1) / step))))
    cut = cut.select("id", "piece", F.substring(F.col("data"), (F.col("piece") * step + 1).cast("int"), F.lit(step)).alias("data"))
    cut = cut.withColumn("group", F.pmod(seeded(F.concat_ws(":", F.col("id").cast("string"), F.col("piece").cast("string"), F.crc32("data").cast("string")), seed), F.lit(groups)))
    tasks = min(groups, 100_000)  # one matrix a task, as far as the scheduler goes
    dealt = cut.select("group", "id", "piece", "data").repartition(tasks, "group").sortWithinPartitions("group", "id", "piece", "data")
    report = ws.cut(dealt.mapInArrow(_pack(root, dtype, length, pad), _REPORT_SQL), "report")
    report.select("temporary", "file").distinct().mapInArrow(_commit(root), "temporary string, file string").write.parquet(f"{root}/manifest")
    remove(spark, f"{root}/_temporary")
    ws.drop(written)
    return report.drop("temporary")


def unpack(spark: SparkSession, root: str, report: DataFrame, dtype: str = "u1") -> DataFrame:
    """(id, piece, data) of all pieces, read back from the matrices."""
    files = spark.read.format("binaryFile").load(f"{root}/data/*.ids.npy").select(F.regexp_extract("path", r"(group-\d+)\.ids\.npy$", 1).alias("file"), "content")

    def run(batches):
        for batch in batches:
            for content, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matrix = np.load(io.BytesIO(content))
                out = [(i, p, matrix[r["row"], a:b].tobytes()) for r in rows for i, p, a, b in zip(r["ids"], r["pieces"], r["cu_lengths"], r["cu_lengths"][1:])]
                i, p, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(p, pa.int64()), pa.array(d, pa.binary())], names=["id", "piece", "data"])

    rows = report.groupBy("file").agg(F.collect_list(F.struct("row", "ids", "pieces", "cu_lengths")).alias("rows"))
    return files.join(rows, "file").select("content", "rows").mapInArrow(run, "id long, piece long, data binary")
