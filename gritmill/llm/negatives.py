"""Hard-negative mining by block matrix products in two dimensions: rows in shards, components in chunks.

Each shard of rows and each chunk of its components is one block, written once as packed integers. An anchors' block meets
the rows' blocks of the same chunk; their product is a partial score tile of int64, cut into strips of a few anchors. The
partial tiles of one strip are shuffled together and added chunk by chunk, and the whole strip is reduced to the first
rows that each anchor wants from it, so no task holds more than a strip and a pair of blocks.

Shards hold the rows of few labels, so positives, which have the anchor's label, are found in the tiles of its own label's shards
alone; negatives in the tiles of all others, when the positives' windows are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, groups_of, tune

#: Rows of a shard on average, anchors of an anchors' block, anchors of a strip, components of a chunk.
ROWS, ANCHORS, STRIP, CHUNK = 1024, 512, 16, 32
#: Sets of labels; a set's rows are spread over as many shards as they need.
SETS = 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least the first and at most the second percentage of the positive's.
LOW, HIGH = 30, 90


_BLOCK = "dim int, grp int, shard int, chunk int, n int, ids binary, info binary, data binary"
#: A tile is named by its two blocks, a strip by its tile and number.
TILE = ["dim", "a_shard", "grp", "shard"]
_PARTIAL = ", ".join(f"{c} int" for c in [*TILE, "strip", "chunk"]) + ", a_ids binary, a_info binary, ids binary, info binary, tile binary"


def _ints(values, n: int) -> pa.Array:
    return pa.array(np.broadcast_to(np.asarray(values, np.int32), n))


def _flat(column: pa.ChunkedArray, rows: int, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(rows, width)


def _packed(chunk: int):
    """Rows that come sorted by block, as one packed block for each chunk of their components."""
    def run(batches):
        for (dim, group, shard), t in groups_of(batches, ["dim", "grp", "shard"]):
            n, chunks = t.num_rows, max(1, -(-int(dim) // chunk))
            ids = t.column("id").to_numpy().astype("<i8").tobytes()
            info = np.concatenate([c.flatten().to_numpy() for c in t.column("info").chunks]).astype("<i8").tobytes()
            x = _flat(t.column("q"), n, int(dim))
            kind = "<i4" if (np.abs(x) < 1 << 30).all() else "<i8"
            data = [x[:, k * chunk : (k + 1) * chunk].astype(kind).tobytes() for k in range(chunks)]
            binary = [pa.array(v, pa.binary()) for v in ([ids] * chunks, [info] * chunks, data)]
            yield pa.RecordBatch.from_arrays([*(_ints(v, chunks) for v in (dim, group, shard, range(chunks), n)), *binary], names=["dim", "grp", "shard", "chunk", "n", "ids", "info", "data"])

    return run


def blocks(rows: DataFrame, chunk: int) -> DataFrame:
    """Packed blocks of rows (dim, grp, shard, id, info: as many numbers in each row, q: the components)."""
    keys = ["dim", "grp", "shard"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, "id", "info", "q").mapInArrow(_packed(chunk), _BLOCK)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact product of two integer matrices, the second transposed: through floats where they hold every sum.
    Raises an OverflowError if a sum may not fit 64 bits."""
    top = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if top < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if top >= 1 << 62:
        raise OverflowError("inner products may not fit 64-bit integers")
    return x.astype(np.int64) @ y.astype(np.int64).T


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * width)}").reshape(n, width) if n * width else np.zeros((n, width), np.int64)


def _multiply(chunk: int):
    """Partial tiles of pairs of blocks, cut into strips; the first chunk brings what is known of the rows."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                width = min(chunk, r["dim"] - r["chunk"] * chunk)
                tile = product(_matrix(r["a_data"], r["a_n"], width), _matrix(r["data"], r["n"], width))
                at = range(0, r["a_n"], STRIP)
                n, first, size = len(at), r["chunk"] == 0, len(r["a_info"]) // r["a_n"]
                cut = lambda b, w: pa.array([b[w * s : w * (s + STRIP)] if first else None for s in at], pa.binary())
                whole = lambda b: pa.array([b if first else None] * n, pa.binary())
                tiles = pa.array([tile[s : s + STRIP].astype("<i8").tobytes() for s in at], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(_ints(r[c], n) for c in TILE), _ints(range(n), n), _ints(r["chunk"], n), cut(r["a_ids"], 8), cut(r["a_info"], size), whole(r["ids"]), whole(r["info"]), tiles],
                    names=[*TILE, "strip", "chunk", "a_ids", "a_info", "ids", "info", "tile"],
                )

    return run


def _added(batches):
    """Whole strips, the sums of their partial tiles, which come sorted by strip and chunk. Holds one strip."""
    at = held = None
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[c] for c in (*TILE, "strip"))
            if key != at:
                if held:
                    yield held
                a_ids, ids, info = (np.frombuffer(r[c], "<i8") for c in ("a_ids", "ids", "info"))
                at, held = key, (a_ids, np.frombuffer(r["a_info"], "<i8").reshape(len(a_ids), -1), ids, info, np.frombuffer(r["tile"], "<i8").reshape(-1, len(ids)).copy())
            else:
                held[4][:] += np.frombuffer(r["tile"], "<i8").reshape(held[4].shape)
    if held:
        yield held


def _found(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(len(rows), len(names)).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _own_label(most: int):
    """Of each strip, every anchor's first other rows of its own label."""
    def run(batches):
        for a_ids, a_info, ids, labels, tile in _added(batches):
            rows = []
            for a, label, score in zip(a_ids.tolist(), a_info[:, 0].tolist(), tile):
                own = np.flatnonzero((labels == label) & (ids != a))
                rows += ((a, ids[k], score[k]) for k in own[np.lexsort((ids[own], -score[own]))[:most]])
            yield _found(rows, ["anchor_id", "positive_id", "positive_score"])

    return run


def _other_labels(most: int, low: int, high: int):
    """Of each strip, the first rows of other labels in the window of each of an anchor's positives, which are one range of
    the rows in order. An anchor's numbers are its label, how many positives it has, and their ids and scores."""
    def run(batches):
        for a_ids, a_info, ids, labels, tile in _added(batches):
            rows = []
            for a, score, (label, n, *positives) in zip(a_ids.tolist(), tile, a_info.tolist()):
                other = np.flatnonzero(labels != label)
                other = other[np.lexsort((ids[other], -score[other]))]
                falling = -score[other]
                for p, value in zip(positives[: 2 * n : 2], positives[1 : 2 * n : 2]):
                    first = int(np.searchsorted(falling, -(high * value // 100)))
                    last = int(np.searchsorted(falling, low * -value // 100, "right"))
                    rows += ((a, p, value, ids[k], score[k]) for k in other[first : min(last, first + most)])
            yield _found(rows, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, chunk: int, reduce, schema: str) -> DataFrame:
    """Multiplies blocks that meet, adds the partial tiles and reduces the strips."""
    a = anchors.select("dim", "a_shard", "grp", "shard", "chunk", F.col("n").alias("a_n"), F.col("ids").alias("a_ids"), F.col("info").alias("a_info"), F.col("data").alias("a_data"))
    partial = a.join(rows, [*TILE, "chunk"]).mapInArrow(_multiply(chunk), _PARTIAL)
    return partial.repartition(*TILE, "strip").sortWithinPartitions(*TILE, "strip", "chunk").mapInArrow(reduce, schema)


def _first(rows: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, scale: int = 256,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows of the
    same label. A row's score is the integer inner product of floor(scale * component) with the anchor's; higher scores come
    first, ties by the smaller id. Rows with a null id, label or vector, or a null or non-finite component take no part. Of
    rows of one id, the one with the smallest label, then vector takes part. Vectors of different lengths don't meet. A
    pair without a negative has no row; an empty table gives an empty result. Scores that may not fit 64 bits raise an
    OverflowError. Other columns are not read; labels are integers.
    """
    ws = Workspace(tune(vectors.sparkSession), "negatives")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    one = plain.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    rows = ws.cut(one.select(
        "id", "r.label", F.size("r.v").alias("dim"), F.pmod(F.xxhash64("r.label"), F.lit(SETS)).cast("int").alias("grp"),
        (F.col("id") % every == 0).alias("anchor"), F.transform("r.v", lambda x: F.floor(x * scale)).alias("q"),
    ), "rows")
    sets = ws.cut(rows.groupBy("dim", "grp").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("shards"), F.ceil(F.count_if("anchor") / ANCHORS).cast("int").alias("a_shards")), "sets")
    dims = ws.cut(rows.groupBy("dim").agg(F.ceil(F.count_if("anchor") / ANCHORS).cast("int").alias("a_shards")).where("a_shards > 0"), "dims")
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = rows.join(sets, ["dim", "grp"])
    own = F.array("label").alias("info")
    shards = ws.cut(blocks(placed.select("dim", "grp", spread("shards", 1).alias("shard"), "id", own, "q"), chunk), "shards")

    anchors = placed.where("anchor").select("dim", "grp", spread("a_shards", 2).alias("shard"), "id", own, "q")
    a = blocks(anchors, chunk).withColumnRenamed("shard", "a_shard").join(sets.drop("a_shards"), ["dim", "grp"]).withColumn("shard", each("shards"))
    x = shards.join(sets.where("a_shards > 0").drop("shards"), ["dim", "grp"]).withColumn("a_shard", each("a_shards"))
    near = _tiles(a, x, chunk, _own_label(positives), "anchor_id long, positive_id long, positive_score long")
    first = ws.cut(_first(near, ["anchor_id"], "positive_score", "positive_id", positives), "positives")

    windows = first.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: F.array(p["positive_id"], p["positive_score"])))
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(2 * positives) - 2 * F.size("p"))
    wanted = rows.where("anchor").join(windows, "id").join(dims, "dim")
    wanted = wanted.select("dim", F.lit(0).alias("grp"), spread("a_shards", 3).alias("shard"), "id", F.concat(F.array("label", F.size("p").cast("long")), flat, padding).alias("info"), "q")
    # at most SETS sets a length of vectors
    tiles = sets.groupBy("dim").agg(F.collect_list(F.struct("grp", "shards")).alias("sets"))
    a = blocks(wanted, chunk).drop("grp").withColumnRenamed("shard", "a_shard").join(tiles, "dim").withColumn("s", F.explode("sets")).select("*", "s.grp", "s.shards").drop("sets", "s").withColumn("shard", each("shards"))
    x = shards.join(dims, "dim").withColumn("a_shard", each("a_shards"))
    found = _tiles(a, x, chunk, _other_labels(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
