"""Media columns by content-defined chunking: rolling gear hash cuts, chunks stored once, verified reconstruction.

A text's UTF-8 bytes, padded with 255 to a positive multiple of ``FRAME``, are the payload of a media object: 8-bit
mono samples after a WAV header. The payload is cut where the gear hash of the last 32 bytes has ``CUT_BITS`` leading
zero bits (chunks have ``LEAST`` to ``MOST`` bytes), so equal passages cut alike wherever they stand.

The store has two tables in the shared folder. ``chunks`` holds each chunk that occurs more than once, by digest, once.
``media`` holds a row per document: the header and the ordered list of chunk digests, with the bytes of those chunks
that occur nowhere else. Which digests repeat is counted with digests alone; a Bloom filter of bounded size tells the
writers, and a chunk that it takes for repeated by mistake is merely stored in ``chunks``. So only repeated chunks
travel. Reading joins the lists with ``chunks``, checks every digest, and puts the media together again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, blocks, buffer_of, mix64, scratch, texts, tune

FRAME = 576
FILL = 255
SAMPLE_RATE = 8000
LEAST, MOST, CUT_BITS = 256, 16_384, 11
#: Bits of the Bloom filter: 16 for each repeated digest, within these bounds. It is broadcast, 16 MB at most.
BLOOM_BITS = (1 << 16, 1 << 27)

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def header(n: int) -> bytes:
    """A canonical 44-byte WAV header of ``n`` 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", n)


def padded(text: bytes) -> bytes:
    return text + bytes([FILL]) * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at each byte: sum of gear[byte] << distance over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h2 = h.copy()
        h2[s:] += h[:-s] << np.uint32(s)
        h = h2
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    marks = (np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist() if len(data) else []
    out, base = [], 0
    for p in payloads:
        at, ends, n = 0, [], len(p)
        while n - at > LEAST:
            k = bisect_left(marks, base + at + LEAST)
            end = min(marks[k] - base if k < len(marks) else n, at + MOST, n)
            ends.append(end)
            at = end
        if at < n:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def features(samples: bytes) -> str:
    """Sixteen level counts, the mean level and the mean step between samples, in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    levels = np.bincount(x >> 4, minlength=16)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(x) - 1)
    return f"levels={','.join(map(str, levels.tolist()))};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};step={step}"


def _payloads(array):
    """Blocks of (first row, payloads, sizes before padding)."""
    data, offsets = buffer_of(texts(array))
    for a, b in blocks(offsets):
        raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
        yield a, [padded(x) for x in raw], [len(x) for x in raw]


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Two places of each digest in the filter (from its first 16 bytes)."""
    x = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    return (x & np.uint64(bits - 1)).astype(np.int64)


def _digest_rows(batches):
    for batch in batches:
        for _, payloads, _ in _payloads(batch.column(0)):
            out = [hashlib.sha256(p[a:b]).digest() for p, e in zip(payloads, cuts(payloads)) for a, b in zip([0, *e], e)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])


def _split(bloom, bits, shared: bool):
    """Rows of ``chunks`` (with repeats), or rows of ``media``."""

    def run(batches):
        words = np.asarray(bloom.value)
        for batch in batches:
            for first, payloads, sizes in _payloads(batch.column(1)):
                ends = cuts(payloads)
                pieces = [[p[a:b] for a, b in zip([0, *e], e)] for p, e in zip(payloads, ends)]
                digests = [[hashlib.sha256(c).digest() for c in own] for own in pieces]
                at = _positions([d for own in digests for d in own], bits)
                hit = iter((((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)).tolist())
                hits = [[next(hit) for _ in own] for own in pieces]
                if shared:
                    seen = {d: c for own, ds, hs in zip(pieces, digests, hits) for c, d, h in zip(own, ds, hs) if h}
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "bytes"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(payloads)),
                            pa.array(sizes, pa.int64()),
                            pa.array([header(len(p)) for p in payloads], pa.binary()),
                            pa.array(digests, pa.list_(pa.binary())),
                            pa.array([[None if h else c for c, h in zip(own, hs)] for own, hs in zip(pieces, hits)], pa.list_(pa.binary())),
                        ],
                        names=["id", "n_bytes", "header", "digests", "inline"],
                    )

    return run


def _bloom(repeated: DataFrame) -> tuple[np.ndarray, int]:
    n = repeated.count()
    bits = BLOOM_BITS[0]
    while bits < min(16 * n, BLOOM_BITS[1]):
        bits *= 2

    def words(batches):
        for batch in batches:
            at = _positions(batch.column(0).to_pylist(), bits).reshape(-1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    got = repeated.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out, bits


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the media of all rows to ``path`` (tables ``media`` and ``chunks``) and returns the path."""
    spark = tune(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ws = Workspace(spark, "chunking")
    counted = plain.select("text").mapInArrow(_digest_rows, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    repeated = ws.cut(counted.where("n > 1").select("digest"), "repeated")
    words, bits = _bloom(repeated)
    ws.close()
    bloom = spark.sparkContext.broadcast(words)
    chunks = plain.mapInArrow(_split(bloom, bits, True), "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    kind = docs.schema[id_col].dataType.simpleString()
    media = plain.mapInArrow(_split(bloom, bits, False), f"id {kind}, n_bytes long, header binary, digests array<binary>, inline array<binary>")
    media.withColumn("uid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/media")
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, n_bytes, header, digests, inline): the stored media with the bytes of all their chunks, in order."""
    media, chunks = spark.read.parquet(f"{path}/media"), spark.read.parquet(f"{path}/chunks")
    whole = ~F.exists("inline", lambda x: x.isNull())
    part = media.where(~whole)
    need = part.select("uid", F.posexplode(F.arrays_zip("digests", "inline")).alias("pos", "c")).where("c.inline is null")
    need = need.select("uid", "pos", F.col("c.digests").alias("digest"))
    fetched = need.join(chunks, "digest").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("got"))
    filled = part.join(fetched, "uid").withColumn("got", F.map_from_entries("got"))
    filled = filled.withColumn("inline", F.transform("inline", lambda x, i: F.coalesce(x, F.element_at("got", i))))
    names = ["id", "n_bytes", "header", "digests", "inline"]
    return media.where(whole).select(names).union(filled.select(names))


def _inspect(batches):
    for batch in batches:
        rows = []
        for n, head, digests, chunks in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            for d, c in zip(digests, chunks):
                if c is None or hashlib.sha256(c).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is missing or damaged")
            media = head + b"".join(chunks)
            if struct.unpack("<I", media[40:44])[0] != len(media) - 44:
                raise ValueError("the media's length differs from its header")
            samples = media[44:]
            rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def inspect(loaded: DataFrame) -> DataFrame:
    """Per stored row: lengths, digests and features of what was read back; a damaged chunk raises an error."""
    kind = loaded.schema["id"].dataType.simpleString()
    return loaded.mapInArrow(_inspect, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Stores all rows' texts as media, reads them back and returns what :func:`inspect` finds, one row per row of
    ``docs``. Null texts count as empty (one frame of 255); null ids stay; equal texts give equal values; repeated rows
    give repeated results; columns other than the two named are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    return inspect(load(spark, store(docs, path or scratch(spark, "media"), id_col, text_col))).withColumnRenamed("id", id_col)
