"""URL filters: rules for hosts and path prefixes, found by digests in sorted arrays that workers map into memory.

A rule is a host and the start of a path; it holds for the host and all its subdomains. The driver writes the rules into one
file: 64-bit digests of the rules' hosts, sorted, with the lengths of the paths that each host has; digests of whole rules,
sorted; and the strings themselves. Spark hands the file to each executor, whose workers map it, so they share its pages.
A worker probes the digests of all distinct host suffixes of a batch by one vectorised binary search, then those of the
suffixes that have rules with the path prefixes in question, and confirms each hit by the stored string, so equal digests
of different strings do no harm. Longer lists of rules take several files, each probed in a pass of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, tune

#: Rules of one file.
RULES = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
_SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def digests(values: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values), np.uint64, len(values))


class Keys:
    """Distinct strings by their sorted digests, with a run of numbers each; arrays may be mapped."""

    def __init__(self, digest, at, data, start, numbers):
        self.digest, self.at, self.data, self.start, self.numbers = digest, at, data, start, numbers

    @classmethod
    def build(cls, runs: dict[str, list[int]], hashed=digests) -> Keys:
        names = list(runs)
        digest = hashed(names)
        order = np.argsort(digest, kind="stable")
        raw = [names[k].encode("utf-8", "surrogatepass") for k in order]
        ends = lambda sizes: np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int64)
        return cls(digest[order], ends([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8), ends([len(runs[names[k]]) for k in order]), np.array([x for k in order for x in runs[names[k]]], np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [self.digest, self.at, self.data, self.start, self.numbers]

    def find(self, names: list[str], hashed=digests) -> list[list[int] | None]:
        """The run of each name, or None: places by binary search, confirmed by the string. Equal digests stand together."""
        wanted = hashed(names)
        first, last = np.searchsorted(self.digest, wanted), np.searchsorted(self.digest, wanted, "right")
        out: list[list[int] | None] = [None] * len(names)
        for i in np.flatnonzero(first < last).tolist():
            raw = names[i].encode("utf-8", "surrogatepass")
            for k in range(first[i], last[i]):
                if self.data[self.at[k] : self.at[k + 1]].tobytes() == raw:
                    out[i] = self.numbers[self.start[k] : self.start[k + 1]].tolist()
        return out


def save(rules: list[tuple[str, str, str]], path: str) -> None:
    """Writes rules (verdict, host, path) as one file: how long each array is, then the arrays. Of equal rules the last holds."""
    lengths: dict[str, set[int]] = {}
    whole: dict[str, list[int]] = {}
    for verdict, host, start in rules:
        if verdict not in VERDICTS or not start.startswith("/"):
            raise ValueError(f"a rule is allow or block, a host and a path that starts with a slash, not {(verdict, host, start)}")
        lengths.setdefault(host, set()).add(len(start))
        whole[host + start] = [VERDICTS.index(verdict)]
    arrays = [a for k in (Keys.build({h: sorted(x) for h, x in lengths.items()}), Keys.build(whole)) for a in k.arrays()]
    with open(path, "wb") as f:
        np.array([len(a) for a in arrays], np.int64).tofile(f)
        for a in sorted(range(10), key=lambda k: -arrays[k].itemsize):  # wide ones first, so all stay aligned
            arrays[a].tofile(f)


def load(path: str) -> tuple[Keys, Keys]:
    """Maps a file of rules into memory: the hosts with their paths' lengths, and the rules with their verdicts."""
    sizes = np.fromfile(path, np.int64, 10)
    kinds = [np.uint64, np.int64, np.uint8, np.int64, np.int64] * 2
    arrays, at = [None] * 10, sizes.nbytes
    for a in sorted(range(10), key=lambda k: -np.dtype(kinds[k]).itemsize):
        n = int(sizes[a])
        arrays[a] = np.memmap(path, kinds[a], "r", at, (n,)) if n else np.zeros(0, kinds[a])
        at += n * np.dtype(kinds[a]).itemsize
    return Keys(*arrays[:5]), Keys(*arrays[5:])


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    out = [host]
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1 :]
        out.append(host)
    return out


def matches(hosts: list[str], paths: list[str], known: Keys, rules: Keys) -> list[tuple[str | None, str | None]]:
    """(rule, verdict) of the longest rule for each host and path; of equally long ones that of the longer host."""
    above = {h: suffixes(h) for h in set(hosts)}
    names = list({s for x in above.values() for s in x})
    lengths = {s: x for s, x in zip(names, known.find(names)) if x}
    tried = [{s + p[:n]: None for s in above[h] for n in reversed(lengths.get(s, ())) if n <= len(p)} for h, p in zip(hosts, paths)]
    names = list({t for x in tried for t in x})
    verdicts = {t: VERDICTS[v[0]] for t, v in zip(names, rules.find(names)) if v}
    out = []
    for x in tried:
        best = max((t for t in x if t in verdicts), key=len, default=None)
        out.append((best, verdicts.get(best)))
    return out


_LOADED: dict[str, tuple[Keys, Keys]] = {}


def _judge(file: str):
    def run(batches):
        if file not in _LOADED:
            _LOADED[file] = load(SparkFiles.get(file))
        for batch in batches:
            hosts, paths = (texts(batch.column(c)).to_pylist() for c in ("host", "path"))
            found = matches(hosts, paths, *_LOADED[file])
            # of rules of several files the longer one holds, then that of the longer host, then the last
            rule, verdict = (batch.column(c).to_pylist() for c in ("rule", "verdict"))
            rank = lambda r: (len(r), r.find("/")) if r else (-1, -1)
            best = [(r, v) if rank(r) >= rank(own) else (own, w) for (r, v), own, w in zip(found, rule, verdict)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_file: int = RULES) -> DataFrame:
    """One row per row: the id, host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    ``rules`` gives (allow or block, host, path start); hosts are lower case. A rule fits its host and all subdomains of it,
    if the path starts with the rule's. ``default`` is the verdict where no rule fits: a list of exceptions says nothing of
    other pages. URLs that are null or have no ``://`` have an empty host and path, which no rule fits. Null ids stay, repeated
    rows are judged each, other columns are not read. Rules pass through the driver ``per_file`` at a time.
    """
    spark = tune(pages.sparkSession)
    folder = tempfile.mkdtemp(prefix="gritmill-")  # Spark's file server hands the files to the executors
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    none = F.lit(None).cast("string")
    out = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), none.alias("rule"), none.alias("verdict"))
    held: list[tuple[str, str, str]] = []

    def probed(df: DataFrame) -> DataFrame:
        file = f"rules-{uuid.uuid4().hex}.bin"
        save(held, os.path.join(folder, file))
        spark.sparkContext.addFile(os.path.join(folder, file))
        return df.mapInArrow(_judge(file), f"id {kind}, host string, path string, rule string, verdict string")

    for rule in rules:
        held.append(tuple(rule))
        if len(held) == per_file:
            out = probed(out)
            held.clear()
    if held:
        out = probed(out)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
