"""Alignment of two tokenizers over the same texts: groups of tokens between shared ends, links, and corpus-wide counts.

A text, with a space before it, is cut where a space follows anything that isn't white space. No pre-token of the byte-level
tokenizer and no piece of the other spans such a place, so each segment is encoded and aligned once and remembered; a
document is the sum of its segments. Segments are aligned many at a time, as one run of bytes: the union of both end
arrays bounds the elementary intervals, ``searchsorted`` finds the tokens that own each interval, an interval whose
end both share closes a group, and the products of the groups expand to links.

Each document's distinct pairs are written once. How many documents hold a pair is counted in the tasks first, then by
Spark. Counts of frequent pairs, a bounded number, go to all tasks as sorted arrays; the other pairs, none of which is
frequent, are joined by key.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import Workspace, texts, tune

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that are aligned together; a longer text is taken whole.
BLOCK_CHARS = 1 << 20
#: Characters of segments (and so many for each of them) that a worker remembers; beyond, it forgets all.
REMEMBERED, EACH = 40_000_000, 60
#: Links of a group beyond which distinct ids are paired, with their numbers, instead of occurrences.
WIDE = 1 << 14
#: Distinct pairs that a task holds before it passes their counts on.
HELD = 2_000_000
#: Pairs whose counts go to all tasks (17 bytes each).
FREQUENT = 4_000_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_REST = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

#: Where a split at single spaces is not enough: other white space before a space, runs of spaces, spaces at either end.
_ODD = re.compile(r"\s | \Z|\A ").search
_SEGMENTS = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*").findall


def segments(text: str) -> list[str]:
    """The segments of space + text, each without its first space."""
    if not _ODD(text):
        return text.split(" ")
    return [s[1:] for s in _SEGMENTS(" " + text)]


class Tokens:
    """Both tokenizers with the bytes of their tokens. The second one's pieces must not go on past a word's end."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: n for n, c in enumerate(byte_symbols())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        plain = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            plain[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces go on past the end of a word")
        own = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.tables = [self._table(plain), self._table(own)]
        self.shift = len(own).bit_length()
        if len(plain).bit_length() + self.shift > 40:
            raise ValueError("the vocabularies are too large")

    @staticmethod
    def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(v) for v in values], np.int64)
        return np.frombuffer(b"".join(values), np.uint8), size, np.cumsum(size) - size

    def encode(self, segs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each segment) by either tokenizer; segments come without their first space."""
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in batch([" " + s for s in segs], add_special_tokens=False)]
        b = [x if s else [self.space] for s, x in zip(segs, self.b.encode(segs, num_threads=1))]
        return [(np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64)) for ids in (a, b)]

    def joined(self, k: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids of one tokenizer."""
        data, size, start = self.tables[k]
        n = size[ids]
        return data[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def elementary(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last byte, last token of a and last token of b of each group, from the ends of the tokens of one run of bytes."""
    ends = np.union1d(a_end, b_end)
    owner_a, owner_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    closes = (a_end[owner_a] == ends) & (b_end[owner_b] == ends)
    return ends[closes], owner_a[closes], owner_b[closes]


def _spans(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate((np.zeros(min(1, len(last)), np.int64), last[:-1] + 1))
    return first, last - first + 1


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of consecutive runs of the given lengths."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class Lexicon:
    """Aligned segments by their text: columns of numbers, the text of their groups, and their pairs."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.shown: list[str] = []
        self.weight = 0
        self.numbers = np.zeros((5, 0), np.int64)  # tokens of a, tokens of b, groups, links, bad
        self.start, self.key, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, segs: list[str]) -> None:
        """Aligns new segments. A segment is bad if the bytes of either's tokens differ from its own."""
        t, first = self.tokens, len(self.shown)
        sides = t.encode(segs)
        raw = [b" " + s.encode("utf-8", "surrogatepass") for s in segs]
        size = np.array([len(r) for r in raw], np.int64)
        bad = np.zeros(len(segs), bool)
        for k, (ids, n) in enumerate(sides):
            row = np.repeat(np.arange(len(segs)), n)
            bad |= np.bincount(row, t.tables[k][1][ids], minlength=len(segs)).astype(np.int64) != size
        for k, (ids, n) in enumerate(sides):
            fits = np.repeat(~bad, n)
            want = np.frombuffer(b"".join(r for r, b in zip(raw, bad) if not b), np.uint8)
            off = np.flatnonzero(t.joined(k, ids[fits]) != want)
            good = np.flatnonzero(~bad)
            bad[good[np.searchsorted(np.cumsum(size[good]), off, "right")]] = True
        good = np.flatnonzero(~bad)
        (a, an), (b, bn) = [(ids[np.repeat(~bad, n)], n) for ids, n in sides]
        end, a_last, b_last = elementary(np.cumsum(t.tables[0][1][a]), np.cumsum(t.tables[1][1][b]))
        (a0, na), (b0, nb) = _spans(a_last), _spans(b_last)
        of = good[np.searchsorted(np.cumsum(size[good]), end)] if len(end) else np.zeros(0, np.int64)
        per = lambda v: np.bincount(of, v, minlength=len(segs)).astype(np.int64)
        self.numbers = np.concatenate((self.numbers, [per(na), per(nb), per(np.ones(len(of))), per(na * nb), bad]), axis=1)

        sa, sb, groups = list(map(str, a.tolist())), list(map(str, b.tolist())), [[] for _ in segs]
        for s, i, n, j, m in zip(of.tolist(), a0.tolist(), na.tolist(), b0.tolist(), nb.tolist()):
            groups[s].append(f"{','.join(sa[i : i + n])}|{','.join(sb[j : j + m])}")
        self.shown += map(";".join, groups)

        wide = na * nb > WIDE
        f, g = a0[~wide], b0[~wide]
        n, m = na[~wide], nb[~wide]
        within = _within(n * m)
        m_of = np.repeat(m, n * m)
        key = (a[np.repeat(f, n * m) + within // m_of] << t.shift) | b[np.repeat(g, n * m) + within % m_of]
        parts = [(np.repeat(of[~wide], n * m), key, np.ones(len(key), np.int64))]
        for k in np.flatnonzero(wide):
            (x, u), (y, v) = (np.unique(z, return_counts=True) for z in (a[a0[k] : a0[k] + na[k]], b[b0[k] : b0[k] + nb[k]]))
            parts.append((np.full(len(x) * len(y), of[k]), ((x << t.shift)[:, None] | y[None, :]).ravel(), np.outer(u, v).ravel()))
        row, key, times = (np.concatenate(x) for x in zip(*parts))
        both, times = summed((row << 40) | key, times)
        row, key = both >> 40, both & ((1 << 40) - 1)
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.bincount(row, minlength=len(segs)))))
        self.key, self.times = np.concatenate((self.key, key)), np.concatenate((self.times, times))
        self.at.update(zip(segs, range(first, first + len(segs))))
        self.weight += sum(map(len, segs)) + EACH * len(segs)

    def align(self, values: list[str]):
        """For each text: tokens of a, tokens of b, groups, links, digest of the groups, distinct pairs and their links."""
        if self.weight > REMEMBERED:
            self.forget()
        cut = [segments(v) if v else [] for v in values]
        new = list({s for c in cut for s in c if s not in self.at})
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        at = [np.fromiter(map(self.at.__getitem__, c), np.int64, len(c)) for c in cut]
        whole = [self.numbers[:, x].sum(axis=1) for x in at]
        fine = [len(x) > 0 and w[4] == 0 for x, w in zip(at, whole)]
        shown = self.shown
        digests = [hashlib.sha256(";".join(map(shown.__getitem__, x.tolist())).encode()).hexdigest() if f else "" for x, f in zip(at, fine)]
        used = [x if f else x[:0] for x, f in zip(at, fine)]
        row = np.repeat(np.arange(len(values)), [len(x) for x in used])
        both, times = np.unique((row << 40) | np.concatenate([*used, np.zeros(0, np.int64)]), return_counts=True)
        row, seg = both >> 40, both & ((1 << 40) - 1)
        n = self.start[seg + 1] - self.start[seg]
        place = np.repeat(self.start[seg], n) + _within(n)
        both, times = summed((np.repeat(row, n) << 40) | self.key[place], self.times[place] * np.repeat(times, n))
        ends = np.searchsorted(both >> 40, np.arange(len(values) + 1))
        key = both & ((1 << 40) - 1)
        for i, (w, f, d) in enumerate(zip(whole, fine, digests)):
            s = slice(ends[i], ends[i + 1])
            yield (*(w[:4].tolist() if f else (0, 0, 0, 0)), d, key[s], times[s])


_LEXICONS: dict[tuple[str, str], Lexicon] = {}


def _lexicon(a_path: str, b_path: str) -> Lexicon:
    if (a_path, b_path) not in _LEXICONS:
        _LEXICONS[a_path, b_path] = Lexicon(Tokens(a_path, b_path))
    return _LEXICONS[a_path, b_path]


def _aligned(a_path: str, b_path: str):
    def run(batches):
        lexicon = _lexicon(a_path, b_path)
        for batch in batches:
            values, first, held = texts(batch.column(2)).to_pylist(), 0, 0
            for last, v in enumerate(values, 1):
                held += len(v)
                if held < BLOCK_CHARS and last < len(values):
                    continue
                out = list(zip(*lexicon.align(values[first:last])))
                numbers = [pa.array(x, pa.int64()) for x in out[:4]]
                pairs = [pa.array([x.astype("<i8").tobytes() for x in col], pa.binary()) for col in out[5:]]
                own = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(out[4], pa.string()), *pairs], names=["row", "id", *NUMBERS, "groups_sha256", "pairs", "times"])
                first, held = last, 0

    return run


def _held(batches):
    """Distinct pairs and in how many rows they are, summed within the task as long as it holds few enough."""
    keys, counts, size = [], [], 0
    for batch in batches:
        data = b"".join(x for x in batch.column(0).to_pylist() if x)
        k, n = np.unique(np.frombuffer(data, "<i8"), return_counts=True)
        keys.append(k)
        counts.append(n)
        size += len(k)
        if size > 2 * HELD:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            if len(k) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "docs"])
                k, n = k[:0], n[:0]
            keys, counts, size = [k], [n], len(k)
    if keys:
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "docs"])


def _looked_up(shared):
    """Adds the sums over the pairs that are among the frequent ones, and the others with their numbers of links."""
    def run(batches):
        pair, docs, best = shared.value
        for batch in batches:
            sums, rest = [], []
            for keys, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                keys, times = np.frombuffer(keys, "<i8"), np.frombuffer(times, "<i8")
                at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                known = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                at, n = at[known], times[known]
                sums.append((int((n * best[at]).sum()), int((n * docs[at]).sum())))
                rest.append([{"pair": k, "times": t} for k, t in zip(keys[~known].tolist(), times[~known].tolist())])
            best_sum, count_sum = zip(*sums) if sums else ((), ())
            own = [batch.column(c) for c in ("row", "id", *NUMBERS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(best_sum, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rest, _REST)], names=["row", "id", *NUMBERS, "groups_sha256", "n_best", "count_sum", "rest"])

    return run


def pair_counts(aligned: DataFrame, ws: Workspace, shift: int) -> DataFrame:
    """(pair, docs, best) of all pairs of an aligned table: how many of its rows hold it, and whether no other pair of the
    same first id is in more."""
    partial = aligned.select("pairs").mapInArrow(_held, "pair long, docs long")
    counted = ws.cut(partial.groupBy("pair").agg(F.sum("docs").alias("docs")), "counts")
    a_id = F.shiftright("pair", shift).alias("a")
    most = counted.groupBy(a_id).agg(F.max("docs").alias("most"))
    return ws.cut(counted.select("pair", "docs", a_id).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "best")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``a_path`` names a byte-level tokenizer's file (``tokenizers`` library), ``b_path`` a sentencepiece model that puts a space
    before its text. Both encode space + text without special tokens. Byte places where both have a token's end cut the
    tokens into groups; all pairs of a group are links. A pair's count is the number of rows that hold it linked; n_best
    counts links whose count is the highest of their first id, count_sum sums the counts of all links. Texts that are
    null, empty, or not given back by the tokens' bytes have zeros and an empty digest, and count for no pair. Null ids
    stay, repeated rows count each, other columns are not read. An empty table gives an empty result.
    """
    import public_tokenizers as P

    a_path, b_path = a_path or P.path(A_FILE), b_path or P.path(B_FILE)
    spark = tune(docs.sparkSession)
    ws = Workspace(spark, "align")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = f"row long, id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string"
    aligned = ws.cut(rows.mapInArrow(_aligned(a_path, b_path), f"{own}, pairs binary, times binary"), "aligned")
    table = pair_counts(aligned, ws, Tokens(a_path, b_path).shift)

    # the smallest power of two from which pairs are few enough to send
    sizes = dict(map(tuple, table.groupBy(F.floor(F.log2("docs")).cast("int").alias("power")).agg(F.count("*")).collect()))
    least, sent = 64, 0
    for power in sorted(sizes, reverse=True):
        if sent + sizes[power] > FREQUENT:
            break
        least, sent = power, sent + sizes[power]
    often = table.where(F.floor(F.log2("docs")) >= least).toArrow()
    pair, times, best = (often.column(k).to_numpy() for k in range(3))
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], times[order], best[order].astype(np.int64)))
    del often, pair, times, best

    found = aligned.mapInArrow(_looked_up(shared), f"{own}, n_best long, count_sum long, rest array<struct<pair: long, times: long>>")
    if sent < sum(sizes.values()):
        found = ws.cut(found, "found")
        seldom = table.where(F.floor(F.log2("docs")) < least)
        links = found.select("row", F.explode("rest").alias("p")).select("row", "p.*").join(seldom, "pair")
        best = F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))
        more = links.groupBy("row").agg(F.sum(best).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_count"))
        added = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        found = found.join(more, "row", "left").select("id", *NUMBERS, "groups_sha256", added("n_best", "more_best"), added("count_sum", "more_count"))
    return found.select(F.col("id").alias(id_col), *NUMBERS, "n_best", "count_sum", "groups_sha256")
