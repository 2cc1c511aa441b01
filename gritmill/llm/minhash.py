"""MinHash near-dedup by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact verification.

A document is the multiset of its shingles: every run of five words (words are runs of characters other than white
space, in lower case); a text of one to four words is one shingle. A shingle of weight w owns the points of a Poisson
process on time x (0, w]. The weight axis is cut into the octaves (0, 1], (1, 2], (2, 4], ...; the points of an octave
come from one hashed stream at the octave's rate, octaves beyond w are never opened, and in the last one a point counts
if its height is at most w. Every point is dealt to one of the signature's places; a place keeps its earliest point. So
two signatures agree in a place with probability sum(min weights) / sum(max weights), and only about m ln m points of a
document are ever made, whatever its length.

Documents whose signatures agree in a whole band meet in a bucket. Links are verified on the whole multisets. Buckets
are not expanded into pairs. Shingles that no other candidate has, and the bits that a hashed bitmap of one shingle
multiset has and the other's lacks, are in no intersection; they bound a pair's similarity from above, so most pairs are
ruled out inside the join, by a few numbers. Representatives, the most central member first, are compared with the
members that remain; buckets whose members are all in one class are done, and the others are split by the triangle
inequality of the Jaccard distance until nothing is open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, blocks, buffer_of, mix64, texts, tune
from .components import components

WORDS = 5
PLACES = 96
ROWS = 4
THRESHOLD = 0.8
#: Buckets of at most so many documents compare all their members at once.
SMALL = 3
#: Representatives of a large bucket in the rounds after the first, which has one; more by this factor each round.
MORE = 16, 16
#: Words of the bitmap of a multiset. It tells texts of up to about 1000 shingles apart; for longer ones its bound is
#: looser, which costs exact comparisons but no link.
BITMAP = [f"w{k}" for k in range(16)]
#: Steps of the histogram of shares by which representatives are chosen.
LEVELS = 256
#: Multisets, or pairs of them, that are worth a task of their own.
SET_ROWS = 256
#: Bytes of text, and words, shingles or points, that the kernels take at a time.
BLOCK_BYTES = 1 << 18
POINTS = 250_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x5851F42D4C957F2D


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for the places of a piece."""
    out = []
    with np.errstate(over="ignore"):
        for x in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(BLOCK_BYTES, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_UP, _DOWN = _powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block of texts, and the row of each. Bytes are taken a piece at a time, and a word
    that a piece cuts goes on in the next, so the work space is bounded whatever the length of a text."""
    sums, sizes, begins = [], [], []
    for p in range(0, len(data), BLOCK_BYTES):
        part = data[p : p + BLOCK_BYTES]
        n = len(part)
        solid = ~_SPACE[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[np.searchsorted(offsets, p) : np.searchsorted(offsets, p + n)] - p
        first[edge] = solid[edge]
        edge = edge[edge > 0]
        last[edge - 1] = solid[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        goes_on = p > 0 and solid[0] and not _SPACE[data[p - 1]] and offsets[min(np.searchsorted(offsets, p), len(offsets) - 1)] != p
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
        own, size = (total[ends] - total[starts]) * _DOWN[starts], (ends - starts).astype(np.uint64)
        if goes_on:
            sums[-1][-1:] += own[:1] * np.uint64(pow(_R, int(sizes[-1][-1]), 1 << 64))
            sizes[-1][-1] += size[0]
            own, size, starts = own[1:], size[1:], starts[1:]
        if len(own):
            sums.append(own)
            sizes.append(size)
            begins.append(starts + p)
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = mix64(np.concatenate(sums) + np.concatenate(sizes) * _BASE)
    return h, (np.searchsorted(offsets, np.concatenate(begins), "right") - 1).astype(np.int32)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Distinct shingles of a block: (row, 64-bit hash, weight), sorted by row and hash; and per row two fingerprints
    of the sequence of its words and their number."""
    rows = len(offsets) - 1
    h, doc = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=rows).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(count)))
    prints = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
    m = max(0, len(h) - words + 1)
    key = np.zeros(m, np.uint64)
    for a in range(0, len(h), POINTS):
        part, own = h[a : a + POINTS], doc[a : a + POINTS]
        place = (np.arange(a, a + len(part)) - begin[own]).astype(np.uint64)
        for k, out in zip((1, 3), prints):
            np.add.at(out, own, mix64(part + (place + np.uint64(k)) * _ODD[k]))
        end = min(a + POINTS, m)
        for k in range(words if a < end else 0):
            key[a:end] += mix64(h[a + k : end + k] + _ODD[k % 5]) * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
        key[a:end] = mix64(key[a:end])
    prints = [mix64(x + count.astype(np.uint64)) for x in prints]
    if m:
        whole = doc[:m] == doc[words - 1 :]
        key, row = key[whole], doc[:m][whole]
    else:
        row = np.zeros(0, np.int32)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        key = np.concatenate((key, mix64(prints[0][few])))
        row = np.concatenate((row, few.astype(np.int32)))
    if rows == 1:
        key.sort()
    else:
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(key))), prints, count


def _octaves(row: np.ndarray, key: np.ndarray, weight: np.ndarray):
    """(row, stream key, rate, lower end of the octave, weight) of all octaves that the weights reach."""
    parts = [(row, key, np.ones(len(row)), np.zeros(len(row)), weight)]
    low, j = 1, 1
    while True:
        more = weight > low
        if not more.any():
            break
        n = int(more.sum())
        parts.append((row[more], mix64(key[more] + np.array([j], np.uint64) * _BASE), np.full(n, float(low)), np.full(n, float(low)), weight[more]))
        low, j = low * 2, j + 1
    return [np.concatenate(x) for x in zip(*parts)]


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, places: int = PLACES) -> np.ndarray:
    """rows x places times of the earliest points (inf for rows without a shingle). Shingles are taken ``POINTS`` at a
    time: streams are independent, and a place keeps a minimum."""
    out = np.full((rows, places), np.inf)
    flat = out.reshape(-1)
    total = np.bincount(row, weight, minlength=rows)
    span = np.zeros(rows)
    some = total > 0
    span[some] = places * (np.log(places) + 3) / total[some]
    todo = some
    while todo.any():
        for a in range(0, len(row), POINTS):
            mine = np.flatnonzero(todo[row[a : a + POINTS]]) + a
            if len(mine):
                _streams(flat, places, span, *_octaves(row[mine], key[mine], weight[mine]))
        todo = some & np.isinf(out).any(axis=1)
        span[todo] *= 2
    return out


def _streams(flat: np.ndarray, places: int, span: np.ndarray, r, k, q, lo, w) -> None:
    """Runs the streams of octaves up to their rows' time spans into the minima ``flat``."""
    end = span[r]
    x, t, step = np.zeros(len(r)), 0, 1
    while len(r):
        pieces = -(-len(r) * step // POINTS)
        alive = []
        for part in np.array_split(np.arange(len(r)), pieces):
            u = mix64(k[part, None] + np.arange(t + 1, t + step + 1, dtype=np.uint64) * _BASE)
            times = x[part, None] + np.cumsum(-np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / q[part, None], axis=1)
            i, j = np.nonzero(times < end[part, None])
            g = part[i]
            u = mix64(u[i, j] + _ODD[1])
            height = lo[g] + q[g] * ((u >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            at = r[g].astype(np.int64) * places + ((u & np.uint64(0xFFFFFFFF)) % np.uint64(places)).astype(np.int64)
            ok = height < w[g]
            np.minimum.at(flat, at[ok], times[i, j][ok])
            stay = times[:, -1] < end[part]
            x[part] = times[:, -1]
            alive.append(part[stay])
        keep = np.concatenate(alive)
        r, k, q, lo, w, x, end = r[keep], k[keep], q[keep], lo[keep], w[keep], x[keep], end[keep]
        t, step = t + step, min(step * 8, 512)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit key of each band; the band's number is part of it."""
    bits = mix64(np.ascontiguousarray(sig).view(np.uint64))
    bands = bits.shape[1] // rows
    key = np.zeros((len(bits), bands), np.uint64)
    for k in range(rows):
        key = mix64(key + bits[:, k : bands * rows : rows] + np.arange(bands, dtype=np.uint64) * _ODD[2])
    return key.view(np.int64)


def _sign(words: int, places: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(pc.utf8_lower(texts(batch.column(3))))
            for a, b in blocks(offsets, BLOCK_BYTES):
                row, key, weight, prints, count = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                keys = band_keys(signatures(row, key, weight, b - a, places), rows)
                some = count > 0
                sizes = np.where(some, keys.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, b - a) for k in range(3)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.array(count),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys[some].reshape(-1))),
                    ],
                    names=["id", "h1", "h2", "f1", "f2", "n_words", "bands"],
                )

    return run


def _sets(words: int):
    """The multiset of a text as a set, and a bitmap of it: each repeat of a shingle gets a hash of its own."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(pc.utf8_lower(texts(batch.column(1))))
            for a, b in blocks(offsets, BLOCK_BYTES):
                row, key, weight, _, _ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                each = np.repeat(np.arange(len(row)), weight)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
                value = np.where(nth == 0, key[each], mix64(key[each] + nth.astype(np.uint64) * _ODD[4]))
                sizes = np.bincount(row[each], minlength=b - a)
                bits = np.zeros((b - a, 64 * len(BITMAP)), np.uint8)
                bits[row[each], (value % np.uint64(bits.shape[1])).astype(np.int64)] = 1
                bits = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(value.view(np.int64))),
                        *(pa.array(np.ascontiguousarray(w)) for w in bits.T),
                    ],
                    names=["node", "items", *BITMAP],
                )

    return run


def _own_items(sets: DataFrame, open_: DataFrame, ws: Workspace, rows: int) -> DataFrame:
    """(node, n, own, bits, bitmap) of the texts, ``rows`` at most, in buckets of more than SMALL: the size of the multiset,
    how much of it none of the others has, and its bitmap. Such shingles are in no intersection, which bounds the
    similarity of a pair from above without looking at its texts."""
    large = open_.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SMALL).select("key")
    heavy = open_.join(large, "key", "left_semi").select("node").distinct()
    mine = ws.cut(sets.join(heavy, "node", "left_semi"), "heavy")
    once = mine.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    once = once.groupBy("node").agg(F.count("*").alias("own"))
    bits = sum(F.bit_count(w) for w in BITMAP)
    out = mine.select("node", F.size("items").alias("n"), bits.alias("bits"), *BITMAP).join(once, "node", "left")
    out = ws.cut(out.select("node", "n", F.coalesce("own", F.lit(0)).alias("own"), "bits", *BITMAP), "own", rows)
    ws.drop(mine)
    return out


#: What a row of an open bucket carries about its text, besides node and key.
KNOWN = ["n", "own", "bits", *BITMAP]


def _common_bits() -> F.Column:
    """How many bits the bitmaps of a member and a representative share."""
    x = F.lit(0)
    for w in BITMAP:
        x = x + F.bit_count(F.col(w).bitwiseAND(F.col(f"rep_{w}")))
    return x


def _may_link(threshold: float) -> F.Column:
    """Whether sizes, own parts and bitmaps let a member and a representative of a large bucket link; true in small ones.
    The bits are counted last: this runs inside the join, for all that meet in a bucket."""
    need = threshold / (1 + threshold) * (F.col("n") + F.col("rep_n")) - 1e-6
    sizes = (F.col("n") - F.col("own") >= need) & (F.col("rep_n") - F.col("rep_own") >= need)
    bits = _common_bits() >= need + F.greatest(F.col("bits") - F.col("n"), F.col("rep_bits") - F.col("rep_n"))
    return ~F.col("big") | (sizes & bits)


def _most() -> F.Column:
    """The largest similarity that sizes, own parts and bitmaps of a member and a representative allow."""
    mine, theirs = F.col("bits") - _common_bits(), F.col("rep_bits") - _common_bits()
    common = F.least(F.col("n") - F.greatest(F.col("own"), mine), F.col("rep_n") - F.greatest(F.col("rep_own"), theirs))
    return common / (F.col("n") + F.col("rep_n") - common)


def _representatives(open_: DataFrame, q: int, turn: int) -> DataFrame:
    """Of each bucket the member with the least share of shingles of its own (main), and about q with the least shares
    (by a histogram of shares, so that no bucket is sorted); all members of a small bucket, or where q reaches its size.
    ``rep_keys`` are the buckets in which a representative is one."""
    share = F.coalesce(F.col("own") / F.col("n"), F.lit(1.0))
    level = F.floor(share * LEVELS)
    marked = open_.select("key", "node", "comp", *KNOWN, level.alias("level"))
    counts = marked.groupBy("key", "level").agg(F.count("*").alias("c"), F.min(F.struct(share.alias("share"), F.xxhash64("node", F.lit(turn)).alias("rank"), "node")).alias("least"))
    by = Window.partitionBy("key").orderBy("level")  # at most LEVELS + 1 rows a bucket
    upto = counts.withColumn("before", F.sum("c").over(by) - F.col("c"))
    sizes = upto.groupBy("key").agg(F.sum("c").alias("size"), F.min("least").alias("least"), F.max(F.when(F.col("before") < q, F.struct("level", "before", "c"))).alias("last"))
    main = F.col("node") == F.col("least.node")
    chosen = (F.col("size") <= SMALL) | main
    if q > 1:
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) * F.col("last.c") < (q - F.col("last.before")) * (1 << 20)
        chosen = chosen | (F.col("level") < F.col("last.level")) | ((F.col("level") == F.col("last.level")) & drawn)
    reps = marked.join(sizes, "key").where(chosen)
    names = [F.col("node").alias("rep"), *(F.col(c).alias(f"rep_{c}") for c in ("comp", *KNOWN))]
    place = F.struct("key", main.alias("main"), (F.col("size") > SMALL).alias("big"))
    lists = reps.groupBy(*names).agg(F.collect_list(place).alias("places"))  # a text is in few buckets
    return lists.withColumn("rep_keys", F.col("places.key")).withColumn("place", F.explode("places")).drop("places").select("*", "place.*").drop("place")


def _undecided(labelled: DataFrame, threshold: float) -> DataFrame:
    """Members of buckets of several components that may link to one of another component. The least own part of the
    other components, o, bounds what a member can reach: (n - own) / (n + o)."""
    least = labelled.groupBy("key", "comp").agg(F.min(F.coalesce("own", F.lit(0))).alias("o"))
    low = least.groupBy("key").agg(F.min(F.struct("o", "comp")).alias("first"), F.count("*").alias("parts")).where("parts > 1")
    # the second: the least of all components but the one that has the first
    second = least.join(low, "key").where("comp <> first.comp").groupBy("key").agg(F.min("o").alias("second"))
    both = low.join(second, "key").select("key", F.col("first.o").alias("o1"), F.col("first.comp").alias("c1"), "second")
    other = F.when(F.col("comp") == F.col("c1"), F.col("second")).otherwise(F.col("o1"))
    can = F.coalesce((F.col("n") - F.col("own")) / (F.col("n") + other) >= threshold, F.lit(True))
    return labelled.join(both, "key").where(can).select(labelled.columns)


def _links(open_: DataFrame, sets: DataFrame, threshold: float, ws: Workspace) -> DataFrame:
    """(node, component) of all texts that link with another one, from the open buckets (key, node, comp, what is KNOWN)."""
    q, turn, found, linked = 1, 0, None, 0
    empty = open_.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    links = empty
    while n := open_.count():  # from the files' footers
        lists = ws.cut(open_.groupBy("node", "comp", *KNOWN).agg(F.collect_list("key").alias("keys")), "members", n)
        ws.drop(open_)
        open_ = lists.withColumn("key", F.explode("keys"))
        reps = ws.cut(_representatives(open_, q, turn), "reps", n)
        # a pair is met in the first bucket only that the member shares with those its representative has
        once = F.array_min(F.array_intersect("keys", "rep_keys")) == F.col("key")
        met = open_.repartition("key", "node").join(reps, "key").where((F.col("node") != F.col("rep")) & (F.col("comp") != F.col("rep_comp")) & _may_link(threshold) & once)
        pairs = ws.cut(met.select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b")).distinct(), "pairs")
        p = pairs.count()
        # the sets of these pairs alone are moved: a written table's size is known, so a small one is broadcast to the scan
        need = ws.cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "need", 2 * p)
        own = ws.cut(sets.select("node", "items").join(need, "node", "left_semi"), "compared", 2 * p, SET_ROWS)
        left = pairs.join(own.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(own.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        inter = F.size(F.array_intersect("x", "y"))
        seen = ws.cut(both.select("a", "b", (inter / (F.size("x") + F.size("y") - inter)).alias("s")), "seen", p, SET_ROWS)
        close = seen.where(F.col("s") >= threshold).select("a", "b")
        if close.limit(1).count():  # else the components stay as they are
            found = components(links.union(close), ws, linked + p)
            linked += p
            links = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        # what the round leaves open: members that were no representative, against those the triangle inequality allows
        rest = (
            open_.join(reps.where("main"), "key")
            .where("node <> rep")
            .withColumn("most", F.when(F.col("big"), _most()).otherwise(1.0))
            .join(reps.select("key", F.col("rep").alias("node")), ["key", "node"], "left_anti")
            .withColumn("a", F.greatest("node", "rep"))
            .withColumn("b", F.least("node", "rep"))
            .join(seen, ["a", "b"], "left")
        )
        # without a comparison (in one component already) a member may be on either side
        near, far = F.coalesce("s", "most") >= 2 * threshold - 1, F.coalesce(F.col("s") < threshold, F.lit(True))
        sides = F.array_compact(F.array(F.when(near, F.lit(0)), F.when(far, F.lit(1))))
        # buckets with one main are one from here on: what meets in any of them meets there, once
        split = rest.select("node", "rep", F.explode(sides).alias("side"), *KNOWN).select("node", F.xxhash64("rep", "side").alias("key"), *KNOWN).distinct()
        if found is None:
            labelled = split.withColumn("comp", F.col("node"))
        else:
            labelled = split.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        labelled = ws.cut(labelled, "labelled", 2 * n)
        open_ = ws.cut(_undecided(labelled, threshold), "open", 2 * n)
        ws.drop(lists, reps, pairs, need, own, seen, labelled)
        q, turn = MORE[0] if q == 1 else MORE[1] * q, turn + 1
    return found if found is not None else empty.toDF("node", "component")


def _keyed(id_: F.Column, text: F.Column) -> list[F.Column]:
    """The key of a row: its id and 128 bits of its text (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [id_.cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, words: int, places: int, rows: int) -> DataFrame:
    """(id, h1, h2, n_words, class_id, kept, copies) of all distinct rows of id and text."""
    spark = tune(docs.sparkSession)
    ws = Workspace(spark, "minhash")
    plain = docs.select(*_keyed(F.col(id_col), F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = ws.cut(plain.mapInArrow(_sign(words, places, rows), "id long, h1 long, h2 long, f1 long, f2 long, n_words long, bands array<long>"), "signed")

    # exact copies: a text is one node whatever the number of its rows; combined before the shuffle
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("least")
    texts_ = signed.where("n_words > 0").groupBy("f1", "f2").agg(least, F.first("bands").alias("bands"))
    rows_ = signed.count()  # from the files' footers
    nodes = ws.cut(texts_.withColumn("node", F.monotonically_increasing_id()), "nodes", rows_)
    exploded = nodes.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = ws.cut(exploded.join(shared, "key", "left_semi").distinct(), "buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "least.h1", "least.h2"), "node")
    wanted = plain.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(wanted, ["h1", "h2"]).select("node", "text")
    sets = ws.cut(wanted.mapInArrow(_sets(words), f"node long, items array<long>, {', '.join(f'{w} long' for w in BITMAP)}"), "sets")

    own = _own_items(sets, buckets, ws, rows_)
    open_ = buckets.join(own, "node", "left").withColumn("comp", F.col("node"))
    # a text with more shingles of its own than the threshold leaves over links with nothing in a large bucket
    possible = F.coalesce((F.col("n") - F.col("own")) / F.col("n") >= threshold, F.lit(True))
    large = buckets.groupBy("key").agg((F.count("*") > SMALL).alias("large"))
    open_ = ws.cut(open_.join(large, "key").where(~F.col("large") | possible).drop("large"), "open")
    ws.drop(buckets, own)
    found = _links(open_, sets, threshold, ws)

    ranked = ws.cut(found.join(nodes.select("node", "least"), "node"), "ranked", rows_)
    tops = ranked.groupBy("component").agg(F.min("least").alias("top"))
    tops = ranked.join(tops, "component").select("node", "top")
    top = nodes.select("f1", "f2", "node", "least").join(tops, "node", "left").select("f1", "f2", F.coalesce("top", "least").alias("top"))
    each = signed.groupBy("id", "h1", "h2", "f1", "f2", "n_words").agg(F.count("*").alias("copies"))
    worded = each.where("n_words > 0").join(top, ["f1", "f2"])
    mine = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("h1") == F.col("top.h1")) & (F.col("h2") == F.col("top.h2"))
    out = worded.select("id", "h1", "h2", "n_words", F.col("top.id").alias("class_id"), mine.alias("kept"), "copies")
    out = out.union(each.where("n_words = 0").select("id", "h1", "h2", "n_words", F.col("id").alias("class_id"), F.lit(True).alias("kept"), "copies"))
    return ws.finish(out)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    words: int = WORDS,
    places: int = PLACES,
    rows: int = ROWS,
) -> DataFrame:
    """One row per distinct row of id and text, so one per document where ids are unique: id, class_id (the smallest id
    of the texts reachable by links of weighted Jaccard >= ``threshold``), n_words, kept.

    Null and empty texts and texts without a word are classes of their own and kept. Rows with a null id take part like
    others; a class has a null class_id if all its ids are null. Repeated rows count once; of an id with several texts
    each has its own row and class. The kept row of a class is the one with the smallest id (null last), and among
    several texts of that id the one with the smallest hash. Columns other than the two named are not read, so any names
    may clash. An empty table gives an empty result.
    """
    out = _classified(docs, id_col, text_col, threshold, words, places, rows)
    return out.select(F.col("id").alias(id_col), "class_id", "n_words", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """One row of ``docs`` for each class, with its columns: the kept one. Of repeated rows of one id and text, which may
    differ in other columns, the one with the smallest hash of all its columns stays."""
    kept = _classified(docs, id_col, text_col, threshold, words, places, rows).where("kept").select("id", "h1", "h2", "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(*_keyed(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), row).alias("l").join(
        kept.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.h1") == F.col("r.h1")) & (F.col("l.h2") == F.col("r.h2"))
    )
    out = keyed.select("row")
    if kept.where("copies > 1").limit(1).count():
        plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        rank = F.xxhash64(*[F.col(f"row.`{c}`") for c in plain])
        several = keyed.where("copies > 1").groupBy("l.id", "l.h1", "l.h2").agg(F.min_by("row", rank).alias("row")).select("row")
        out = keyed.where("copies = 1").select("row").union(several)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
