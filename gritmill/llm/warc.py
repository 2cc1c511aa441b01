"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id: ranges come from a histogram of payload bytes over ids, refined where a bin is
heavy, so the same table always gives the same shards. A shard is one sorted run in one task, which writes gzip members
and begins a new file when the compressed size passes ``ROLL_BYTES``. Headers and digests are regenerated from the
payload; a payload that an earlier page has becomes a revisit record. Tasks write under temporary names of their own
attempt and report their files; the report of the attempts that succeeded is the manifest, and only files in it are
renamed to their final names, so lost executors and repeated attempts leave no trace. The manifest is written last.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, remove, scratch, tune

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16 << 20
#: Payload bytes that a shard holds about.
SHARD_BYTES = 24 << 20
#: Payloads at least so long are stored once.
REVISIT_BYTES = 100
#: All records carry one date, so that runs agree byte by byte.
DATE = "2024-01-01T00:00:00Z"
_BINS = 4096
_PIECE = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(name: str):
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page, url: str | None, payload: bytes, original) -> bytes:
    """One record: a response with an HTTP head and the payload, or a revisit whose block is the head alone. The head's
    Content-Length is the payload's in both."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if original is not None else head + payload
    uri = "" if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {_sha(payload)}",
        f"WARC-Block-Digest: {_sha(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(original)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"software: gritmill\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: {_sha(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(stream: bytes):
    """(headers, block) of each record of a file, one gzip member after the other; digests are checked."""
    at, view = 0, memoryview(stream)
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + _PIECE]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = body[: int(headers["Content-Length"])]
        if body[len(block) :] != b"\r\n\r\n" or _sha(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
        yield headers, block


def _ranges(sizes: DataFrame, wanted: int) -> list[int]:
    """Lower bounds of the shards' id ranges (the first is open below): a histogram of bytes over ids, and again over
    each range that holds far more than ``wanted``. What reaches the driver is a bounded number of bins each time."""
    ends = sizes.agg(F.min("id"), F.max("id")).first()
    if ends[0] is None:
        return []
    bounds, todo = set(), [(int(ends[0]), int(ends[1]) + 1)]
    while todo:
        low, high = todo.pop()
        width = max(1, -(-(high - low) // _BINS))
        # ids may span all longs: the offset is taken as an exact decimal
        offset = F.col("id").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")
        part = sizes.where((F.col("id") >= low) & (F.col("id") < high)) if high <= 1 << 62 else sizes.where(F.col("id") >= low)
        bins = part.groupBy(F.floor(offset / F.lit(str(width)).cast("decimal(38,0)")).cast("long").alias("bin")).agg(F.sum("n").alias("n")).collect()
        bounds.add(low)
        total = 0
        for bin_, n in sorted((r["bin"], r["n"]) for r in bins):
            at = low + bin_ * width
            if total and total + n > wanted:
                bounds.add(at)
                total = 0
            total += n
            if n > 4 * wanted and width > 1:
                todo.append((at, min(at + width, high)))
    return sorted(bounds)[1:]


def _write(root: str, roll: int):
    """Sorted rows of a shard, decisions before pages, to files under temporary names; yields the files' report."""

    def run(batches):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root)

        def close(out, shard, seq, temporary, records, size, digest):
            out.close()
            return {"shard": shard, "seq": seq, "temporary": temporary, "file": f"part-{shard:06d}-{seq:05d}.warc.gz", "records": records, "bytes": size, "sha256": digest.hexdigest()}

        open_, shard_now, seq = None, None, 0
        decided_page, decided = None, {}  # originals by digest of the payloads of one id
        report = []
        for batch in batches:
            for shard, page, kind, digest, original, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if page != decided_page:
                    decided_page, decided = page, {}
                if kind == 0:
                    decided[digest] = original
                    continue
                if shard != shard_now:
                    if open_:
                        report.append(close(*open_))
                    open_, shard_now, seq = None, shard, 0
                if open_ is None:
                    temporary = f"_temporary/{uuid.uuid4().hex}.warc.gz"
                    at.create_dir(f"{base}/_temporary", recursive=True)
                    out = at.open_output_stream(f"{base}/{temporary}", compression=None)
                    head = member(_info(f"part-{shard:06d}-{seq:05d}.warc.gz"))
                    out.write(head)
                    open_ = [out, shard, seq, temporary, 0, len(head), hashlib.sha256(head)]
                data = payload or b""
                mine = original if page is None else decided.get(hashlib.sha256(data).hexdigest()) if decided else None
                z = member(record(page, url, data, mine))
                open_[0].write(z)
                open_[4] += 1
                open_[5] += len(z)
                open_[6].update(z)
                if open_[5] >= roll:
                    report.append(close(*open_))
                    open_, seq = None, seq + 1
            if report:
                yield pa.RecordBatch.from_pylist(report, schema=_REPORT)
                report = []
        if open_:
            yield pa.RecordBatch.from_pylist([close(*open_)], schema=_REPORT)

    return run


_REPORT = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("temporary", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_REPORT_SQL = "shard long, seq long, temporary string, file string, records long, bytes long, sha256 string"


def _commit(root: str):
    """Renames the manifest's files; a file that an earlier attempt renamed is left alone."""

    def run(batches):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            at.create_dir(f"{base}/data", recursive=True)
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                if at.get_file_info(f"{base}/data/{name}").type == fs.FileType.NotFound:
                    at.move(f"{base}/{temporary}", f"{base}/data/{name}")
            yield batch

    return run


def decisions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(id, digest, n, original): original is the smallest id with the payload if it is another one and the payload has
    at least ``least`` bytes, else null. Rows that repeat the original's id are responses too; a payload that only rows
    without an id have has no original."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    other = ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("id", "digest", "n", F.when(other, F.col("first")).alias("original"))


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes all rows of ``pages`` below ``root`` (data/*.warc.gz, manifest) and returns the manifest. Null html is an
    empty payload, null urls an empty target. Rows without an id come first, each with the id "null"."""
    spark = tune(pages.sparkSession)
    ws = Workspace(spark, "warc")
    decided = ws.cut(decisions(pages, id_col, html_col), "decided")
    starts = _ranges(decided.where("id is not null").select("id", "n"), shard_bytes)
    # shard of an id: how many ranges start at or below it (a bounded array, searched by the JVM)
    edges = F.array(*[F.lit(x).cast("long") for x in starts]) if starts else F.array().cast("array<bigint>")
    shard = F.coalesce(F.size(F.filter(edges, lambda x: x <= F.col("id"))), F.lit(0)).cast("long")
    url = F.col(url_col).cast("string")
    body = pages.select(F.col(id_col).cast("long").alias("id"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("original"), url.alias("url"), F.col(html_col).cast("binary").alias("payload"))
    first = decided.where("id is null and original is not null").count()
    if first:  # rows without an id carry their original themselves
        own = decided.where("id is null and original is not null").select("digest", F.col("original").alias("o")).distinct()
        nulls = body.where("id is null").drop("digest").withColumn("digest", F.sha2(F.coalesce("payload", F.lit(b"")), 256)).join(own, "digest", "left")
        body = body.where("id is not null").unionByName(nulls.select("id", "kind", "digest", F.col("o").alias("original"), "url", "payload"))
    notes = decided.where("original is not null and id is not null").select("id", F.lit(0).alias("kind"), "digest", "original", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")).distinct()
    rows = body.union(notes).select(shard.alias("shard"), "id", "kind", "digest", "original", "url", "payload")
    ordered = rows.repartitionById(len(starts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", "kind", "url", "payload")
    written = ws.cut(ordered.mapInArrow(_write(root, roll), _REPORT_SQL), "report")
    committed = written.mapInArrow(_commit(root), _REPORT_SQL)
    committed.drop("temporary").write.parquet(f"{root}/manifest")
    remove(spark, f"{root}/_temporary")
    ws.close()
    return spark.read.parquet(f"{root}/manifest")


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for headers, block in parse(content):
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                n = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (n != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} in {path} is damaged")
                refers = headers.get("WARC-Refers-To")
                rows.append({"id": _page(headers["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else _page(refers), "target": headers["WARC-Target-URI"], "payload": payload if kind == "response" else None})
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)


_READ = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of all files of the manifest, digests checked: id, payload_bytes, payload_digest, record_type,
    refers_to, target, payload (null for revisits). A file holds about ROLL_BYTES, so one fits a task's memory."""
    if not spark.read.parquet(f"{root}/manifest").limit(1).count():
        return spark.createDataFrame([], "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary")
    files = spark.read.format("binaryFile").load(f"{root}/data/*.warc.gz").select("path", "content")
    return files.mapInArrow(_read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary")


def archive(pages: DataFrame, root: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Writes the archives, reads them back and returns a row per record: id, payload_bytes, payload_digest,
    record_type, refers_to. An empty table gives an empty result; other columns are not read."""
    spark = pages.sparkSession
    root = root or scratch(spark, "archive")
    write_warc(pages, root, id_col, **options)
    back = read_warc(spark, root)
    return back.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
