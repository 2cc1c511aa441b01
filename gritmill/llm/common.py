"""Shared helpers: scratch tables in the cluster's shared folder, Arrow text buffers, 64-bit mixing in numpy."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of one Arrow batch; texts may be very long, so batches are kept small.
BATCH_ROWS = 256
#: Bytes of text that the numpy kernels take at a time; they take longer texts in pieces.
BLOCK_BYTES = 1 << 18
#: Rows that are worth a task of their own where a table's size is known.
TASK_ROWS = 4096


def tune(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, and keeps Arrow batches small enough for very long texts: the session's
    spark.sql.execution.arrow.maxRecordsPerBatch is lowered to BATCH_ROWS if it is higher, for good."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gritmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system API."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as error:
        logging.getLogger(__name__).warning("scratch path %s stays: %s", path, str(error)[:300])


#: Scratch paths that are still there; they are deleted when the process ends.
_ROOTS: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in list(_ROOTS.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            if spark.sparkContext._jsc is not None:
                remove(spark, path)


class Workspace:
    """Tables written in the shared folder to cut lineage; :meth:`drop` deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, scratch(spark, name), 0
        _ROOTS[self.root] = spark

    def few(self, df: DataFrame, rows: int | None, task_rows: int = TASK_ROWS) -> DataFrame:
        """The same rows in as few tasks as ``rows``, about their number, are worth; never in more than there are.
        Partitions are joined without a shuffle, so that small tables don't cost a task and a file for each of them."""
        tasks = -(-rows // task_rows) if rows else 1
        whole = rows is None or tasks >= int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df if whole else df.coalesce(tasks)

    def cut(self, df: DataFrame, name: str = "t", rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
        """Writes the rows as Parquet and reads them back: executors may be lost without losing them. ``rows`` is about
        how many there are, where that is known (see :meth:`few`)."""
        self.made += 1
        df = self.few(df, rows, task_rows)
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                remove(self.spark, path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result and deletes all other tables; the result itself goes when the session's process ends."""
        path = f"{self.root}-result"
        _ROOTS[path] = self.spark
        df.write.option("compression", "zstd").parquet(path)
        self.close()
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.root)
        _ROOTS.pop(self.root, None)


def crc_of(col: Column) -> Column:
    """crc32 of the value as text (null stays null)."""
    return F.crc32(col.cast("string").cast("binary"))


def texts(array) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    return pc.fill_null(array, "")


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the offsets of its values, without copying."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows (first, last + 1) of about ``limit`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(col: Column, seed: str) -> Column:
    """A seeded 60-bit non-negative hash of a value, the same in Spark and in any engine with MD5."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def groups_of(batches, keys: list[str]):
    """Runs of equal keys in batches that come sorted by them, each as one Arrow table.

    Only one run is held at a time, so callers bound what a run can hold.
    """
    held: list[pa.Table] = []
    at = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if key != at and held:
                yield at, pa.concat_tables(held)
                held = []
            at = key
            held.append(t.slice(a, b - a))
    if held:
        yield at, pa.concat_tables(held)
