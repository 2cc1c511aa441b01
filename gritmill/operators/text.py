"""Shared windows of words and equal texts.

Windows are counted without a row for each: the least hash of the runs of GRAM words in a window is its key, so equal windows
have equal keys. Neighbouring windows that take their key from the same place travel as one stretch of text, some three times
the texts in all before they are compressed by buckets of keys. All places of a window meet in one bucket, where hashes only
tell which windows may be shared and the words themselves decide.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Words whose hash can be the key of a window: longer runs are less often frequent, but make shorter stretches.
GRAM = 3
#: Bytes of text that the kernels take at a time; a longer text is taken alone, a word of that length by its CRC.
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
#: Different stretches that a task counts before it sends them on, and stretches that are looked at together.
COUNTED, TOGETHER = 200_000, 8192
#: Parts of a bucket, by key: stretches of different parts share no window.
PARTS = 256
#: Windows of a stretch at most, as their marks share a long.
MARKS = 60
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word; the bytes are taken a piece at a time, cut at spaces."""
    if not _POWERS:
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PIECE_BYTES + 1, x, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(data):
        stop = at + PIECE_BYTES
        if stop < len(data):
            stop = data.rfind(b" ", at, stop) + 1 or data.find(b" ", stop) + 1 or len(data)
        stop = min(stop, len(data))
        part = np.frombuffer(data, np.uint8, stop - at, at)
        solid = np.zeros(len(part) + 2, np.int8)
        solid[1:-1] = part != 32
        edge = np.diff(solid)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start) == 1 and end[0] - start[0] >= PIECE_BYTES:
            h = np.array([crc32(data[at + start[0] : at + end[0]])], np.uint64)
        else:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(part)], out=total[1:])
            h = (total[end] - total[start]) * _POWERS[1][start]
        out.append((start + at, end + at, _mix(h + (end - start).astype(np.uint64) * np.uint64(_BASE))))
        at = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return _mix(total)


class _Block:
    """The windows of some texts: the text, first word and hash of each; :meth:`texts` has their words."""

    def __init__(self, values: list[bytes], size: int):
        self.size, self.data = size, b" ".join(values)
        self.plain = b"  " not in self.data
        self.start, self.end, self.words = _hashed_words(self.data)
        begin = np.cumsum([0] + [len(v) + 1 for v in values])
        of = np.searchsorted(begin, self.start, "right") - 1
        n = max(0, len(self.words) - size + 1)
        self.at = np.flatnonzero(of[:n] == of[size - 1 :]) if n else np.zeros(0, np.int64)
        self.row = of[self.at]
        self.hash = _runs(self.words, size)[self.at] if n else np.zeros(0, np.uint64)

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words from each first window to the last one, a space between two."""
        ends = zip(self.start[self.at[first]].tolist(), self.end[self.at[last] + self.size - 1].tolist())
        out = [self.data[a:b] for a, b in ends]
        return out if self.plain else [b" ".join(filter(None, x.split(b" "))) if b"  " in x else x for x in out]

    def new(self) -> np.ndarray:
        """Whether a window's words come there for the first time in its text."""
        key = _mix(self.hash + self.row.astype(np.uint64) * np.uint64(_BASE))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        new = np.ones(len(key), bool)
        seen = set()
        some = np.unique(np.concatenate((order[same - 1], order[same])))
        for k, *known in zip(some.tolist(), self.row[some].tolist(), self.texts(some, some)):
            known = tuple(known)
            new[k] = known not in seen
            seen.add(known)
        return new

    def stretches(self):
        """(key, first window, last window) of the windows that follow each other and take their key from one place."""
        gram = min(GRAM, self.size)
        width = self.size - gram + 1
        grams = _runs(self.words, gram)
        place = np.lib.stride_tricks.sliding_window_view(grams, width)[self.at].argmin(1) + self.at
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])
        if width > MARKS:
            cut |= self.at % MARKS == 0
        first = np.flatnonzero(cut)
        return grams[place[first]].astype(np.uint32), first, np.append(first[1:], len(place)) - 1


_PACKED_SQL = "bucket int, rows int, parts binary, marks binary, n binary, sizes binary, content binary, own array<string>"


def _pack(array: np.ndarray | bytes) -> bytes:
    return pa.compress(array if isinstance(array, bytes) else array.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, rows * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _stretch(size: int, buckets: int):
    def rows(counts: Counter):
        """One row for each bucket of keys: its stretches by parts of the bucket, compressed together."""
        key, own, marks, content = zip(*counts)
        key, marks, n = np.array(key, np.int64), np.array(marks, np.int64), np.fromiter(counts.values(), np.int64)
        bucket, part = key % buckets, (key // buckets % PARTS).astype(np.uint8)
        order = np.lexsort((key, part, bucket))
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            some = order[a:b]
            values, ids = [content[k] for k in some.tolist()], [own[k] for k in some.tolist()]
            sizes = np.fromiter(map(len, values), np.int64)
            packed = [_pack(x) for x in (part[some], marks[some], n[some], sizes, b"".join(values))]
            yield [int(bucket[some[0]]), len(some), *packed, ids if any(x is not None for x in ids) else None]

    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.string())]
    names = [x.split()[0] for x in _PACKED_SQL.split(", ")]

    def send(counts: Counter):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(counts)), kinds)], names=names)
        counts.clear()

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            value, own, once = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(value):
                stop, held = at, 0
                while stop < len(value) and (stop == at or held + len(value[stop]) <= BLOCK_BYTES):
                    held += len(value[stop])
                    stop += 1
                block = _Block(value[at:stop], size)
                if len(block.at):
                    key, first, last = block.stretches()
                    bit = np.arange(len(block.at)) - np.repeat(first, last - first + 1)
                    marks = np.add.reduceat((block.new() & np.array(once[at:stop])[block.row]).astype(np.int64) << bit, first)
                    ids = [own[at + r] for r in block.row[first].tolist()]
                    counts.update(zip(key.tolist(), ids, marks.tolist(), block.texts(first, last)))
                at = stop
                if len(counts) >= COUNTED:
                    yield from send(counts)
        if counts:
            yield from send(counts)

    return run


def _shared(size: int):
    def found(content: list[bytes], own: list[str | None], marks: np.ndarray, n: np.ndarray):
        block = _Block(content, size)
        row = block.row
        first = np.searchsorted(row, row, "left")
        docs = n[row] * ((marks[row] >> (np.arange(len(row)) - first)) & 1)
        several = np.array([x is not None for x in own])[row]
        _, kind = np.unique(block.hash, return_inverse=True)
        may = np.flatnonzero((np.bincount(kind, np.where(several, 1, docs)) >= 2)[kind])
        out: dict[bytes, list] = {}
        for text, d, places, id_ in zip(block.texts(may, may), docs[may].tolist(), n[row[may]].tolist(), map(own.__getitem__, row[may].tolist())):
            known = out.get(text)
            if known is None:
                known = out[text] = [0, 0, None]
            known[0] += d
            known[1] += places
            if id_ is not None:
                if known[2] is None:
                    known[2] = set()
                known[2].add(id_)
        result = [(hashlib.sha256(t).hexdigest(), d + len(ids or ()), places) for t, (d, places, ids) in out.items() if d + len(ids or ()) >= 2]
        if result:
            a, b, c = zip(*result)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["hash", "n_docs", "n_places"])

    def bucket(held: list[dict]):
        part, marks, n, sizes = (np.concatenate([_unpack(h[c], h["rows"], k) for h in held]) for c, k in (("parts", "u1"), ("marks", "i8"), ("n", "i8"), ("sizes", "i8")))
        content, own = [], []
        for h in held:
            size_ = _unpack(h["sizes"], h["rows"], "i8")
            data = pa.decompress(h["content"], int(size_.sum()), codec="zstd", asbytes=True)
            end = np.cumsum(size_)
            content += [data[a:b] for a, b in zip((end - size_).tolist(), end.tolist())]
            own += h["own"] or [None] * h["rows"]
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=PARTS)).tolist()
        at = 0
        for end in ends:
            if end - at >= TOGETHER or end == ends[-1] > at:
                some = order[at:end]
                yield from found([content[k] for k in some.tolist()], [own[k] for k in some.tolist()], marks[some], n[some])
                at = end

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield from bucket(held)
                    held = []
                held.append(row)
        if held:
            yield from bucket(held)

    return run


def clone_windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(hash, n_docs, n_places) of word windows that at least two documents share; groups are counted, never expanded
    into pairs. Null and short texts have no window; rows that repeat an id count as one document, those without one as
    none. One task holds the different stretches of one bucket of keys, four buckets a shuffle partition."""
    spark = ship(docs.sparkSession)
    id_ = F.col(id_col)
    repeated = docs.where(id_.isNotNull()).groupBy(id_.alias("__id")).count().where("count > 1").select("__id", F.lit(True).alias("__again"))
    some = docs.select(id_.alias("__id"), F.col(text_col).cast("binary").alias("value")).where("value is not null")
    if repeated.isEmpty():  # no text is moved then
        some = some.withColumn("__again", F.lit(None).cast("boolean"))
    else:
        some = some.join(repeated, "__id", "left")
    again = F.coalesce(F.col("__again"), F.lit(False))
    texts = some.select("value", F.when(again, F.col("__id").cast("string")).alias("own"), (F.col("__id").isNotNull() & ~again).alias("once"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretches = texts.mapInArrow(_stretch(size, buckets), _PACKED_SQL)
    return stretches.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(size), "hash string, n_docs long, n_places long")


def equal_texts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Groups of documents with equal texts: digest, members, first id, whether they span sources."""
    return docs.groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("digest")).agg(
        F.count("*").alias("members"), F.min(id_col).alias("first_id"), (F.count_distinct(source_col) > 1).alias("across_sources")
    ).where("members >= 2")
