"""Clones of source code: tokens, windows of tokens, groups of equal regions and the lines that they take.

Two equal windows lie on a run of equal tokens. What begins a run is told without pairs: windows of one hash whose left
contexts are all equal begin none, so only classes with different left contexts go on. The texts that follow their windows,
as far as any two can agree, are sorted; neighbours' common prefixes give the nested intervals of a suffix tree, and each
interval is a group of the windows that meet one of another branch there with another left context.

The tables of windows and places grow with the texts by factors that Spark can't guess, so their joins are merge joins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .intervals import merge_intervals
from .rounds import settled, spread

#: Keywords of the languages read.
KEYWORDS = """async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return
super switch this throw try typeof var void while with yield enum implements interface package private protected public static type declare
def elif except from global lambda nonlocal pass raise and or not is as
abstract boolean byte char double final float int long native short synchronized throws transient volatile""".split()
#: Operators, delimiters and the pattern of a token.
OPERATORS = "+ - * / % ** ++ -- = += -= *= /= %= == === != !== < > <= >= && || ! ?? & | ^ ~ << >> >>> ? : => ->".split()
DELIMITERS = "( ) { } [ ] ; , .".split()
TOKEN = r"""(["'`])(?:(?=(\\?))\2[\s\S])*?\1|\b\d+(?:\.\d+)?\b|[a-zA-Z_$][a-zA-Z0-9_$]*|===|!==|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|&&|\|\||[+\-*/%&|^~<>!=]=?|[(){}\[\];:,.]"""


def _kind(token: Column) -> Column:
    return (
        F.when(token.rlike("""^["'`0-9]"""), "literal").when(token.isin(KEYWORDS), "keyword").when(token.rlike("^[a-zA-Z_$]"), "identifier")
        .when(token.isin(OPERATORS), "operator").when(token.isin(DELIMITERS), "delimiter").otherwise("other")
    )


JAVASCRIPT = r"\.(js|jsx|ts|tsx|mjs|cjs)$"
_TOKEN = pa.struct([("raw", pa.string()), ("norm", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end", pa.int32())])


def _norm(raw, kind, when=None):
    """How a token is compared."""
    if when is None:
        return {"literal": "$LIT", "identifier": "$ID", "keyword": f"kw:{raw}", "operator": f"op:{raw}", "delimiter": f"del:{raw}"}.get(kind, raw)
    prefix = lambda p: F.concat(F.lit(p), raw)
    return when(kind == "literal", "$LIT").when(kind == "identifier", "$ID").when(kind == "keyword", prefix("kw:")).when(kind == "operator", prefix("op:")).when(kind == "delimiter", prefix("del:")).otherwise(raw)


def _script(batches):
    """Tokens of JavaScript files; import statements have none."""
    from ..sources.javascript import scan

    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, out, skipping = scan(text, not re.search(r"\.[mc]?ts$", path.lower()))[0], [], False
            for i, t in enumerate(found):
                after = found[i + 1].raw if i + 1 < len(found) else ""
                before = found[i - 1] if i else None
                if t.kind == "word" and t.raw == "import" and after not in ("(", ".") and (before is None or before.end < t.line or before.raw in (";", "}")):
                    skipping = True
                if skipping and t.raw != "import" and before.end < t.line and before.raw not in _GOES_ON and t.raw not in _GOES_ON | {"}"}:
                    skipping = False  # an unfinished import ends with its line
                if skipping:
                    # up to the module's name and a semicolon on its line
                    skipping = not (t.raw == ";" or (t.kind == "string" and not (after == ";" and found[i + 1].line == t.end)))
                    continue
                kind = (
                    "keyword" if t.kind == "word" or (t.kind == "name" and t.raw in _WORDS) else "identifier" if t.kind == "name"
                    else "literal" if t.kind in ("string", "num", "regexp", "text", "template") else "operator" if t.raw in _OPERATORS else "delimiter" if t.raw in _DELIMITERS else "other"
                )
                out.append({"raw": t.raw, "norm": _norm(t.raw, kind), "kind": kind, "line": t.line, "end": t.end})
            rows.append(out)
        lines = pa.array([t.count("\n") + 1 for t in batch.column(1).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), lines, pa.array(rows, pa.list_(_TOKEN))], names=["path", "lines", "tokens"])


#: Tokens of an import statement around which lines may end.
_GOES_ON = {"import", "{", ",", "from", "*", "as", "type"}
_WORDS, _OPERATORS, _DELIMITERS = set(KEYWORDS), set(OPERATORS), set(DELIMITERS)
_SCHEMA = "path string, lines int, tokens array<struct<raw: string, norm: string, kind: string, line: int, end: int>>"


def _generic(files: DataFrame) -> DataFrame:
    def of_line(line, i):
        bare = F.trim(line)
        skip = (bare == "") | bare.rlike(r"^(//|#|/\*|import |from |package )")
        raws = F.when(skip, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
        return F.transform(raws, lambda t: F.struct(t.alias("raw"), _kind(t).alias("kind"), (i + 1).alias("line")))

    lines = F.split("text", "\n")
    found = files.select("path", F.size(lines).alias("lines"), F.flatten(F.transform(lines, of_line)).alias("t"))
    token = lambda t: F.struct(t["raw"].alias("raw"), _norm(t["raw"], t["kind"], F.when).alias("norm"), t["kind"].alias("kind"), t["line"].alias("line"), t["line"].alias("end"))
    return found.select("path", "lines", F.transform("t", token).alias("tokens"))


def tokens(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, lines, tokens: array of struct(raw, norm, kind, line, end)) of each file. JavaScript and TypeScript files are
    scanned, without comments and import statements; others are read by one general pattern a line, and lines that are
    blank, comments or imports have no token. Identifiers and literals become $ID and $LIT, other tokens stand for themselves
    with their kind. Null paths and texts have no row; paths must be distinct."""
    ship(files.sparkSession)
    known = spread(files.where(F.col(text).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text")), "path")
    script = F.lower("path").rlike(JAVASCRIPT)
    return known.where(script).mapInArrow(_script, _SCHEMA).unionByName(_generic(known.where(~script)))


#: An odd factor of rolling hashes modulo 2^64, and its inverse.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of all stretches of a file's tokens in constant time."""

    def __init__(self, ids: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * _powers(_FACTOR, len(ids)), dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(ids) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _coded(batches):
    """Each file's normalised tokens as 64-bit codes."""
    for batch in batches:
        flat = batch.column(1).flatten()
        norm = flat.field("norm").dictionary_encode()
        codes = np.array([_hash64(x) for x in norm.dictionary.to_pylist()], np.uint64)
        codes = codes[norm.indices.to_numpy()] if len(norm) else codes
        ends = np.concatenate(([0], np.cumsum([len(x) for x in batch.column(1)]))).astype(np.int64)
        data = [codes[a:b].astype("<u8").tobytes() for a, b in zip(ends, ends[1:])]
        kinds, line, last = flat.field("kind").to_pylist(), flat.field("line").to_numpy().astype("<i4"), flat.field("end").to_numpy().astype("<i4")
        kind = np.array([1 if k == "delimiter" else 2 if k in ("keyword", "identifier", "literal") else 0 for k in kinds], np.uint8)
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), cut(kind), cut(line), cut(last)], names=["path", "codes", "kinds", "line", "last"])


def _qualifying(size: int, least_lines: int, most_delimiters: float, least_words: int):
    def run(batches):
        for batch in batches:
            for path, codes, kinds, line, last in zip(*(c.to_pylist() for c in batch.columns)):
                ids, kind = np.frombuffer(codes, "<u8"), np.frombuffer(kinds, np.uint8)
                n = len(ids) - size + 1
                if n < 1:
                    continue
                within = lambda mark: (lambda c: c[size:] - c[:-size])(np.concatenate(([0], np.cumsum(kind == mark))))
                spread = np.frombuffer(last, "<i4")[size - 1 :] - np.frombuffer(line, "<i4")[:n] + 1
                at = np.flatnonzero((spread >= least_lines) & (within(1) / size <= most_delimiters) & (within(2) >= least_words))
                if not len(at):
                    continue
                rolling = _Rolling(ids)
                # what stands before a window, back to the last one that qualifies; the first has a context of its own
                left = rolling.of(np.concatenate((at[:1], at[:-1])), at)
                left[0] = _hash64(f"{path}|")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at.astype(np.int32)), pa.array(rolling.of(at, at + size).astype(np.int64)), pa.array(left.astype(np.int64))], names=["path", "start", "hash", "left"])

    return run


def windows(tokenized: DataFrame, size: int = 40, least_lines: int = 4, most_delimiters: float = 0.75, least_words: int = 5) -> DataFrame:
    """(path, start, hash, left) of all windows of ``size`` tokens, by place from 0, that span enough lines, hold few enough
    delimiters and enough keywords, identifiers and literals. ``left`` is the hash of what stands before the window, back to
    the file's last window that qualifies."""
    return _windows(_codes(tokenized), size, least_lines, most_delimiters, least_words)


def _codes(tokenized: DataFrame) -> DataFrame:
    ship(tokenized.sparkSession)
    return tokenized.select("path", "tokens").mapInArrow(_coded, "path string, codes binary, kinds binary, line binary, last binary")


def _windows(codes: DataFrame, *rules) -> DataFrame:
    return codes.mapInArrow(_qualifying(*rules), "path string, start int, hash long, left long")


def _lengthened(size: int):
    """Hashes of the stretches of twice, four times ... a window's length that begin at the places of a file."""
    def run(batches):
        for batch in batches:
            for path, codes, starts in zip(*(c.to_pylist() for c in batch.columns)):
                rolling, starts = _Rolling(np.frombuffer(codes, "<u8")), np.array(starts, np.int64)
                n, k = len(codes) // 8, 1
                while len(at := starts[starts + (size << k) <= n]):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(rolling.of(at, at + (size << k)).astype(np.int64))], names=["path", "start", "k", "hash"])
                    k += 1

    return run


def _following(size: int):
    """The codes from each place on, as far as another place may agree."""
    def run(batches):
        for batch in batches:
            for path, codes, places in zip(*(c.to_pylist() for c in batch.columns)):
                for first in range(0, len(places), 64):
                    part = places[first : first + 64]
                    cut = [codes[8 * p["start"] : 8 * (p["start"] + (size << (p["k"] + 1)))] for p in part]
                    yield pa.RecordBatch.from_arrays([pa.array([p["hash"] for p in part], pa.int64()), pa.array(cut, pa.binary()), pa.array([path] * len(part)), pa.array([p["start"] for p in part], pa.int32()), pa.array([p["left"] for p in part], pa.int64())], names=["hash", "following", "path", "start", "left"])

    return run


class _Nest:
    """The suffix tree's intervals over the sorted places of one class of windows; holds each place's path, start and left
    context, not what follows it. A subtree is (first, last, places by left context)."""

    def __init__(self, size: int):
        self.size, self.places, self.found = size, [], []
        self.at: dict[tuple[str, int], int] = {}
        self.stack: list[tuple[int, list]] = []

    def add(self, path: str, start: int, left: int, agreed: int) -> None:
        """The next place, and how many tokens it has in common with the one before."""
        i = len(self.places)
        if i:
            self._meet(agreed)
        self.places.append((path, start, left))
        self.at[path, start] = i
        self.last = (i, i, {left: [i]})

    def _meet(self, agreed: int) -> None:
        while self.stack and self.stack[-1][0] > agreed:
            depth, parts = self.stack.pop()
            self._close(depth, [*parts, self.last])
        if agreed < self.size:
            return
        if self.stack and self.stack[-1][0] == agreed:
            self.stack[-1][1].append(self.last)
        else:
            self.stack.append((agreed, [self.last]))

    def finish(self) -> list[tuple[str, int, int]]:
        """(path, start, length) of all instances."""
        self._meet(-1)
        return self.found

    def _close(self, depth: int, parts: list) -> None:
        whole = Counter()
        for _, _, by in parts:
            for left, own in by.items():
                whole[left] += len(own)
        first, last = parts[0][0], parts[-1][1]
        for a, b, by in parts:
            for left, own in by.items():
                # places of other branches with other left contexts, less those too near in the same file
                others = last - first - (b - a) - (whole[left] - len(own))
                for i in own if others > 0 else ():
                    if others >= self.size or others > self._near(i, first, last, a, b, left):
                        self.found.append((*self.places[i][:2], depth))
        parts.sort(key=lambda p: p[1] - p[0])
        joined = parts.pop()[2]
        for _, _, by in parts:
            for left, own in by.items():
                joined.setdefault(left, []).extend(own)
        self.last = (first, last, joined)

    def _near(self, i: int, first: int, last: int, a: int, b: int, left: int) -> int:
        path, start, _ = self.places[i]
        n = 0
        for d in range(1, (self.size + 1) // 2):
            for other in (self.at.get((path, start - d)), self.at.get((path, start + d))):
                n += other is not None and first <= other <= last and not a <= other <= b and self.places[other][2] != left
        return n


def _repeated(size: int):
    def flushed(nest):
        found = nest.finish()
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], names=["path", "start", "length"])

    def run(batches):
        key, nest, before = None, None, b""
        for batch in batches:
            for h, following, path, start, left in zip(*(c.to_pylist() for c in batch.columns)):
                if h != key:
                    if nest:
                        yield flushed(nest)
                    key, nest, before = h, _Nest(size), b""
                n = min(len(before), len(following))
                differ = np.flatnonzero(np.frombuffer(before[:n], "<u8") != np.frombuffer(following[:n], "<u8")) if before[:n] != following[:n] else ()
                nest.add(path, start, left, int(differ[0]) if len(differ) else n // 8)
                before = following
        if nest:
            yield flushed(nest)

    return run


def _regions(batches):
    for batch in batches:
        for path, toks, places in zip(*(c.to_pylist() for c in batch.columns)):
            norm, raw = [t["norm"] for t in toks], [t["raw"] for t in toks]
            digest = lambda field, p: hashlib.sha256("|".join(field[p["start"] : p["start"] + p["length"]]).encode("utf-8", "surrogatepass")).hexdigest()
            for first in range(0, len(places), 1024):
                part = places[first : first + 1024]
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(norm, p)[:32] for p in part]), pa.array([digest(raw, p) for p in part]), pa.array([p["length"] for p in part], pa.int32()), pa.array([path] * len(part)),
                    pa.array([toks[p["start"]]["line"] for p in part], pa.int32()), pa.array([toks[p["start"] + p["length"] - 1]["end"] for p in part], pa.int32()),
                ], names=["clone_hash", "raw_hash", "token_count", "path", "start_line", "end_line"])


def clone_places(tokenized: DataFrame, size: int = 40, least_lines: int = 4) -> DataFrame:
    """(path, start, length): the instances of all groups of equal regions, in tokens.

    Two equal windows, of different files or half a window apart, begin a run if what stands before them differs, back to
    the last window of each that qualifies; the run goes on to the last token that they have in common. A group is what
    equals a run, an instance a place that begins one of the group's length with another place. No pair is made: see the
    module. Places of one class of windows, some 200 bytes each, are held by one task."""
    codes = settled(_codes(tokenized))
    w = settled(_windows(codes, size, least_lines, 0.75, 5))
    mixed = w.groupBy("hash").agg(F.min("left").alias("a"), F.max("left").alias("b")).where("a <> b").select("hash")
    begun = settled(w.join(mixed.hint("merge"), "hash", "left_semi"))
    code = codes.select("path", "codes")
    longer = settled(code.join(begun.groupBy("path").agg(F.collect_list("start").alias("starts")).hint("merge"), "path").mapInArrow(_lengthened(size), "path string, start int, k int, hash long"))
    again = longer.groupBy("k", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    reach = longer.join(again.hint("merge"), ["k", "hash"], "left_semi").groupBy("path", "start").agg(F.max("k").alias("k"))
    place = F.struct("start", "hash", "left", F.coalesce("k", F.lit(0)).alias("k"))
    wanted = begun.join(reach.hint("merge"), ["path", "start"], "left").groupBy("path").agg(F.collect_list(place).alias("places"))
    following = code.join(wanted.hint("merge"), "path").mapInArrow(_following(size), "hash long, following binary, path string, start int, left long")
    return following.repartition("hash").sortWithinPartitions("hash", "following", "path", "start").mapInArrow(_repeated(size), "path string, start int, length int")


def clone_regions(tokenized: DataFrame, size: int = 40, least_lines: int = 4) -> DataFrame:
    """(clone_hash, type, token_count, path, start_line, end_line): the instances of each group of equal regions, which are
    those of :func:`clone_places`. A region's hash is that of its normalised tokens; TYPE_1 if all tokens of all instances are
    equal as written, else TYPE_2. In the order of their lines, an instance goes whose both ends lie within two lines of one
    that was kept in its file; groups with fewer than two kept instances go too. An empty table gives an empty result."""
    tokenized = settled(tokenized)
    places = clone_places(tokenized, size, least_lines).groupBy("path").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    cut = tokenized.select("path", "tokens").join(places.hint("merge"), "path")
    region = settled(cut.mapInArrow(_regions, "clone_hash string, raw_hash string, token_count int, path string, start_line int, end_line int"))
    lines = F.array_sort(F.collect_list(F.struct("start_line", "end_line")))
    near = lambda x: lambda y: (F.abs(x["start_line"] - y["start_line"]) <= 2) & (F.abs(x["end_line"] - y["end_line"]) <= 2)
    keep = lambda kept, x: F.when(F.exists(kept, near(x)), kept).otherwise(F.concat(kept, F.array(x)))
    of_file = region.groupBy("clone_hash", "path", "token_count").agg(lines.alias("l"), F.min("raw_hash").alias("a"), F.max("raw_hash").alias("b"))
    folded = of_file.withColumn("l", F.aggregate("l", F.array().cast("array<struct<start_line: int, end_line: int>>"), keep))
    groups = folded.groupBy("clone_hash").agg(F.sum(F.size("l")).alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("n > 1")
    kind = groups.select("clone_hash", F.when(F.col("a") == F.col("b"), "TYPE_1").otherwise("TYPE_2").alias("type"))
    return folded.select("clone_hash", "token_count", "path", F.explode("l").alias("l")).join(kind.hint("merge"), "clone_hash").select("clone_hash", "type", "token_count", "path", "l.start_line", "l.end_line")


def clone_groups(regions: DataFrame) -> DataFrame:
    """(clone_hash, type, token_count, instances, line_count, is_intra_file) of each group."""
    return regions.groupBy("clone_hash", "type", "token_count").agg(
        F.count("*").alias("instances"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("line_count"), (F.min("path") == F.max("path")).alias("is_intra_file")
    )


def duplication(tokenized: DataFrame, regions: DataFrame) -> DataFrame:
    """(total_lines, duplicated_lines, ratio, clones, groups, intra, inter) of all files: a file's duplicated lines are the
    union of its regions, at most its lines; the ratio has four decimals, 0 without lines. clones counts instances."""
    union = merge_intervals(regions.select("path", "start_line", "end_line"), ["path"], "start_line", "end_line").groupBy("path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("d"))
    lines = tokenized.join(union.hint("merge"), "path", "left").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum(F.least(F.coalesce("d", F.lit(0)), "lines")), F.lit(0)).alias("duplicated_lines"))
    groups = clone_groups(regions).agg(F.coalesce(F.sum("instances"), F.lit(0)).alias("clones"), F.count("*").alias("groups"), F.count_if("is_intra_file").alias("intra"), F.count_if(~F.col("is_intra_file")).alias("inter"))
    ratio = F.coalesce(F.round(F.try_divide("duplicated_lines", "total_lines"), 4), F.lit(0.0))
    return lines.join(groups).select("total_lines", "duplicated_lines", ratio.alias("ratio"), "clones", "groups", "intra", "inter")  # one row each
