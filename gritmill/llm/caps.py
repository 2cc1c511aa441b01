"""Embedding near-dedup by spherical-cap filters with structured random product codes.

Vectors are rotated at random and split into three blocks; each block has a small code book of random unit vectors, and
every triple of code words is a filter direction. A vector is list-decoded to all filters whose inner product with it
exceeds the cap's bound: block by block, prefixes that cannot reach the bound any more are dropped, so the work follows
the length of the list and not the number of filters. Vectors meet in the filters they share and are verified in double
precision. The number of filters grows with the number of vectors, so filters keep their size.

Equal vectors are collapsed first. Pairs are not emitted: large filters are cut into blocks that meet as block pairs, a
task counts each vector's links and keeps a spanning forest, and a pair that shares several filters counts in the
smallest of them only, so nothing need be made distinct afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, groups_of, tune
from .components import components

THRESHOLD = 0.95
#: Filters that a vector falls into on average, and the least that each gets by lowering its own bound.
LIST = 24
LIST_LEAST = 10
#: Vectors to a filter if they were spread evenly.
PER_FILTER = 8
#: Vectors of a filter's block: a task compares at most this many with as many.
BLOCK = 1024
#: Vectors on which the bound is fitted.
FIT_ON = 400


class Code:
    """Rotation and code books for one dimension and number of filters; the same seed gives the same code anywhere."""

    def __init__(self, dim: int, filters: int, seed: int = 3):
        rng = np.random.default_rng((seed, dim))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.parts = [p for p in np.array_split(np.arange(dim), min(3, dim)) if len(p)]
        self.books, self.size = [], max(2, int(np.ceil(filters ** (1 / len(self.parts)))))
        for p in self.parts:
            b = rng.normal(size=(self.size, len(p)))
            self.books.append(b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(len(self.parts)))

    def decode(self, unit: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose inner product with the row is at least its bound."""
        turned = unit @ self.rotation
        scores = [turned[:, p] @ b.T for p, b in zip(self.parts, self.books)]
        best = [s.max(axis=1) for s in scores]
        row, code, have = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            room = bound[row] - sum(b[row] for b in best[k + 1 :]) - have
            i, j = np.nonzero(s[row] >= room[:, None])
            have, code, row = have[i] + s[row[i], j], code[i] * self.size + j, row[i]
        return row, code

    def lists(self, unit: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`decode` with one bound; rows with too short a list get a lower bound until it is long enough."""
        todo, own = np.arange(len(unit)), np.full(len(unit), bound)
        rows, codes = [], []
        while len(todo):
            row, code = self.decode(unit[todo], own[todo])
            n = np.bincount(row, minlength=len(todo))
            enough = (n >= min(LIST_LEAST, self.size ** len(self.parts))) | (own[todo] < -1)
            keep = enough[row]
            rows.append(todo[row[keep]])
            codes.append(code[keep])
            todo = todo[~enough]
            own[todo] -= 0.03
        row, code = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(codes or [np.zeros(0, np.int64)])
        order = np.lexsort((code, row))
        return row[order], code[order]


def fit_bound(code: Code, unit: np.ndarray, wanted: float = LIST) -> float:
    """The bound at which the sample's lists have ``wanted`` filters on average, by bisection."""
    low, high = -1.0, 1.0
    wanted = min(wanted, code.size ** len(code.parts) / 2)
    for _ in range(30):
        mid = (low + high) / 2
        # from above: short lists are cheap to count
        if mid > 0.15 or code.size ** len(code.parts) < 20_000:
            n = len(code.decode(unit, np.full(len(unit), mid))[0]) / max(1, len(unit))
        else:
            n = float("inf")
        low, high = (mid, high) if n > wanted else (low, mid)
    return high


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode_rows(plans):
    codes: dict = {}

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                filters, bound = plans[int(dim)]
                if dim not in codes:
                    codes[dim] = Code(int(dim), filters)
                row, code = codes[dim].lists(_unit(_matrix(part.column(2))), bound)
                n = np.bincount(row, minlength=part.num_rows)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], names=["cid", "dim", "v", "n", "filters"])

    return run


def _labels(v: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of the part of the bipartite graph ``v`` that each row and column is in."""
    x, y = ids_x.copy(), ids_y.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_y = np.minimum(y, np.where(v, x[:, None], top).min(axis=0, initial=top))
        new_x = np.minimum(x, np.where(v, new_y[None, :], top).min(axis=1, initial=top))
        if (new_x == x).all() and (new_y == y).all():
            return x, y
        x, y = new_x, new_y


def _compare(threshold: float):
    def sides(t, b):
        ids, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        lists = t.column("filters").to_pylist()
        return ids, n, _unit(_matrix(t.column("v"))), lists

    def run(batches):
        for (dim, f, i, j), t in groups_of(batches, ["dim", "f", "bi", "bj"]):
            block = t.column("b").to_numpy()
            x = sides(t.filter(pa.array(block == i)), i)
            y = x if i == j else sides(t.filter(pa.array(block == j)), j)
            if not len(x[0]) or not len(y[0]):
                continue
            v = x[2] @ y[2].T >= threshold
            if i == j:
                np.fill_diagonal(v, False)
            rows, cols = v.any(axis=1), v.any(axis=0)
            if not rows.any():
                continue
            v = v[np.ix_(rows, cols)]
            # a pair counts in the smallest filter it shares
            names = {}
            marks = []
            for ids, keep in ((x, rows), (y, cols)):
                r, c = [], []
                for k, at in enumerate(np.flatnonzero(keep)):
                    for g in ids[3][at]:
                        if g >= f:
                            break
                        r.append(k)
                        c.append(names.setdefault(g, len(names)))
                marks.append((int(keep.sum()), r, c))
            if names:
                a, b = (np.zeros((n, len(names)), np.float32) for n, _, _ in marks)
                a[marks[0][1], marks[0][2]] = 1
                b[marks[1][1], marks[1][2]] = 1
                v &= a @ b.T == 0
            ids_x, ids_y = x[0][rows], y[0][cols]
            lx, ly = _labels(v, ids_x, ids_y)
            links_x = v @ y[1][cols]
            if i == j:
                out = [ids_x, links_x, lx]
            else:
                out = [np.concatenate(z) for z in ((ids_x, ids_y), (links_x, x[1][rows] @ v), (lx, ly))]
            some = out[1] > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(z[some].astype(np.int64)) for z in out], names=["cid", "links", "label"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per id: id, n_links (other vectors of cosine >= ``threshold``), component_id (smallest id reachable by
    links, itself included), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths. Repeated rows count once; an id with several vectors gets the links of all. Rows with a null id
    are left out. Ties need no rule, as components and counts don't depend on order. Other columns are not read. The
    cosine is taken in double precision. An empty table gives an empty result.
    """
    spark = tune(vectors.sparkSession)
    ws = Workspace(spark, "caps")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = plain.where(F.coalesce(fine, F.lit(False))).select("id", "v").distinct()
    classes = ws.cut(good.groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("n")).select("cid", F.size("v").alias("dim"), "v", "n"), "classes")
    member = ws.cut(good.join(classes, "v").select("id", "cid", "n"), "member")

    plans = {}
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        filters = max(64, r["n"] // PER_FILTER)
        code = Code(r["dim"], filters)
        # a seeded sample of about FIT_ON vectors; the hash decides, so its size is bounded in all likelihood
        part = F.pmod(F.xxhash64("cid"), F.lit(1 << 40)) < int(min(1.0, FIT_ON / r["n"]) * (1 << 40)) + 1
        some = classes.where((F.col("dim") == r["dim"]) & part).select("v").toArrow()
        plans[r["dim"]] = (filters, fit_bound(code, _unit(_matrix(some.column(0)))))

    kind = classes.schema["v"].dataType.simpleString()
    decoded = ws.cut(classes.mapInArrow(_decode_rows(plans), f"cid long, dim int, v {kind}, n long, filters array<bigint>"), "decoded")
    each = decoded.select("cid", "dim", F.explode("filters").alias("f"))
    sizes = each.groupBy("dim", "f").agg(F.count("*").alias("size")).where("size > 1")
    placed = decoded.withColumn("f", F.explode("filters")).join(sizes, ["dim", "f"])
    k = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = placed.select("cid", "dim", "v", "n", "filters", "f", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    keys = ["dim", "f", "bi", "bj"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = ws.cut(pairs.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "cid long, links long, label long"), "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("label").alias("b")).union(member.where("id <> cid").select(F.col("id").alias("a"), F.col("cid").alias("b"))), ws)
    counted = member.join(links, "cid", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = plain.select("id").distinct().join(counted, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
