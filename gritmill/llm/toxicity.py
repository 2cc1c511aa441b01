"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 characters, with the white space beside the word as its ends), each
hashed to an embedding; unseen misspellings share n-grams with words that were learned. The embeddings of ``WINDOW``
consecutive words are averaged and a linear softmax scores the window; a document counts as its worst window, so a few
words stand out in a long text as in a short one. Training is joint and by turns: windows are scored, the worst one of
each sampled document takes the document's label (beside random windows of clean documents), and embeddings and softmax,
both of random beginnings, are updated by SGD with steps scaled alike (Adagrad). The worst window's score becomes a
probability by a logistic fit on documents kept back.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, buffer_of, crc_of, free_name, texts, tune
from .sampling import labelled_sample

BITS = 18
DIM = 8
WINDOW = 4
#: Training rows of each label at most.
PER_LABEL = 2500
#: Step of Adagrad, for embeddings and softmax alike.
RATE = 0.3
#: Windows of a step.
BATCH = 192

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(33), *b".,;:!?()[]{}\"'`|<>/\\"]] = 32


def _padded(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each between spaces, white space and marks as spaces, and the offsets of the texts."""
    data, offsets = buffer_of(pc.binary_join_element_wise(" ", pc.utf8_lower(array), " ", ""))
    return _FOLD[data], offsets


def _chars(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the place of the first byte of each."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4"), np.flatnonzero((data & 0xC0) != 0x80)


def word_ngrams(data: np.ndarray, bits: int = BITS):
    """For n of 3 to 5: (bucket, valid) of the n-gram at each character; only its ends may be white space."""
    h = data
    solid = data != 32
    ok = None
    for n in range(2, 6):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n >= 3:
            inner = solid[n - 2 : n - 2 + len(h)]
            ok = inner.copy() if ok is None else ok[: len(h)] & inner
            yield (h + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits), ok


def words_of(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
    """Mean weight of the n-grams of each word: (word's mean, its row, its first byte), in order. A row longer than a
    block is taken in pieces that begin and end at white space."""
    if len(offsets) == 2 and len(data) > BLOCK_BYTES:
        gaps, found, at = np.flatnonzero(data == 32), [], 0
        while at < len(data) - 1:
            k = np.searchsorted(gaps, min(at + BLOCK_BYTES, len(data) - 1))
            end = int(gaps[min(k, len(gaps) - 1)])
            end = end if end > at else len(data) - 1
            value, row, start = _block_words(data[at : end + 1], np.array([0, end + 1 - at]), weights)
            found.append((value, row, start + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found))
    return _block_words(data, offsets, weights)


def _block_words(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
    chars, place = _chars(data)
    total, count = np.zeros(len(chars)), np.zeros(len(chars), np.int32)
    for ids, ok in word_ngrams(chars, int(np.log2(len(weights)))):
        total[: len(ids)] += weights[ids] * ok
        count[: len(ids)] += ok
    start = np.flatnonzero(chars == 32)
    if not len(start):
        return np.zeros(0), np.zeros(0, np.int64), start
    total, count = np.add.reduceat(total, start), np.add.reduceat(count, start)
    some = count > 0
    start = place[start[some]]
    return total[some] / count[some], np.searchsorted(offsets, start, "right") - 1, start


def windows(value: np.ndarray, row: np.ndarray, rows: int, size: int = WINDOW):
    """All windows of ``size`` words (one shorter window for shorter rows): (mean, first word, end, row)."""
    n = np.bincount(row, minlength=rows)
    end_of = np.cumsum(n)
    first = np.arange(len(value))
    is_first = first == (end_of - n)[row]
    end = np.minimum(first + size, end_of[row])
    keep = (end - first == size) | is_first
    first, end = first[keep], end[keep]
    total = np.concatenate(([0.0], np.cumsum(value)))
    return (total[end] - total[first]) / (end - first), first, end, row[keep]


def worst(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The largest value of each row, -inf for rows without one."""
    out = np.full(rows, -np.inf)
    if len(value):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[at]] = np.maximum.reduceat(value, at)
    return out


@dataclasses.dataclass
class ToxicityModel:
    weights: np.ndarray  # of each bucket: how much its embedding adds to label 1 over label 0
    bias: float
    slope: float
    shift: float
    embeddings: np.ndarray | None = None  # for inspection; scores need the weights alone

    def margins(self, array: pa.Array) -> np.ndarray:
        found = [np.zeros(0)]
        data, offsets = _padded(array)
        for a, b in blocks(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            value, row, _ = words_of(part, own, self.weights)
            mean, _, _, at = windows(value, row, b - a)
            found.append(worst(mean, at, b - a) + self.bias)
        return np.concatenate(found)

    def scores(self, array: pa.Array) -> np.ndarray:
        z = self.slope * np.maximum(self.margins(array), -50) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift of a logistic fit, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = max(a - d[0], 1e-3), b - d[1]
    return float(a), float(b)


def train(rows: list[tuple[str, int]], seed: int = 11, turns: int = 4, bits: int = BITS) -> ToxicityModel:
    """Fits embeddings and softmax on (text, label) rows; every fifth row is kept back for the logistic fit. With rows
    of one label only, all scores are that label's rate."""
    size = 1 << bits
    y = np.array([int(label) for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return ToxicityModel(np.zeros(size, np.float32), 0.0, 1e-3, float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    data, offsets = _padded(pa.array([t for t, _ in rows]))
    held = np.arange(len(rows)) % 5 == 4
    e = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    e_sum, w_sum = np.zeros(size, np.float32), np.zeros(w.shape, np.float32)

    def measured(weights):
        """words_of over the sample, block by block, so that memory follows the block."""
        found = []
        for a, b in blocks(offsets):
            value, row, start = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights)
            found.append((value.astype(np.float32), (row + a).astype(np.int32), start + offsets[a]))
        return [np.concatenate(x) for x in zip(*found)]

    _, row, start = measured(np.zeros(size, np.float32))
    stop = np.append(np.flatnonzero(data == 32), len(data))
    stop = stop[np.searchsorted(stop, start, "right")]

    def bag(first, end):
        a, b = start[first], stop[end - 1]
        return np.concatenate([ids[ok] for ids, ok in word_ngrams(_chars(data[a : b + 1])[0], bits)])

    pool: dict[int, np.ndarray] = {}
    marks: dict[int, int] = {}
    for turn in range(turns):
        weights = e @ (w[:, 1] - w[:, 0])
        value, _, _ = measured(weights)
        mean, first, end, at = windows(value, row, len(rows))
        fitted = ~held[at]
        chosen: list[int] = []
        if turn:
            top = worst(mean, at, len(rows))
            hit = np.flatnonzero((mean == top[at]) & fitted)
            _, one = np.unique(at[hit], return_index=True)
            chosen += hit[one].tolist()
            clean = np.flatnonzero(fitted & (y[at] == 0))
            chosen += rng.choice(clean, min(len(clean), 2000), replace=False).tolist()
            pool = {k: v for k, v in pool.items() if marks[k] == 0}
        else:
            for label, n in ((0, 20_000), (1, 20_000)):
                own = np.flatnonzero(fitted & (y[at] == label))
                if len(own):
                    chosen += rng.choice(own, min(len(own), n), replace=False).tolist()
        for k in chosen:
            if k not in pool:
                pool[k] = bag(first[k], end[k])
            marks[k] = int(y[at[k]])
        keys = np.array(sorted(pool))
        for _ in range(3 if turn else 2):
            order = rng.permutation(keys)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                bags = [pool[k] for k in part]
                ids = np.concatenate(bags)
                n = np.array([len(b) for b in bags])
                begin = np.cumsum(n) - n
                hidden = np.add.reduceat(e[ids], begin, axis=0) / n[:, None]
                z = hidden @ w + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), [marks[k] for k in part]] -= 1
                back = np.repeat((p @ w.T) / n[:, None], n, axis=0).astype(np.float32)
                grad = hidden.T @ p
                w_sum += grad * grad
                w -= RATE * grad / np.sqrt(w_sum + 1e-8)
                bias -= 0.1 * RATE * p.sum(axis=0) / len(part)
                by = np.argsort(ids)
                edge = np.flatnonzero(np.diff(ids[by].astype(np.int64), prepend=-1))
                used, g = ids[by[edge]], np.add.reduceat(back[by], edge, axis=0)
                e_sum[used] += (g * g).mean(axis=1)
                e[used] -= RATE * g / np.sqrt(e_sum[used] + 1e-10)[:, None]
    model = ToxicityModel((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, e)
    back = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else np.arange(len(rows))
    margin = np.maximum(model.margins(pa.array([rows[k][0] for k in back])), -50)
    model.slope, model.shift = _logistic(margin, y[back])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, learn=None) -> ToxicityModel:
    """Trains on at most about ``per_label`` labelled documents of each label; rows whose crc32(doc_id as text) mod 5
    is 0 are never learned from. ``learn`` may replace that condition on doc_id."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(crc_of(F.col("id")) % 5 != 0 if learn is None else learn).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    plain = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return dataclasses.replace(train(labelled_sample(plain, known, per_label, "toxicity")), embeddings=None)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", columns: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score (0 to 1) of every whole text and 1 if it is at least 0.5, else 0. Null and empty texts get the
    score of a text without words. Existing columns of these names are replaced; all others stay. Equal texts get equal
    scores. An empty table gives an empty one."""
    cast = tune(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(cast.value.scores(texts(pa.Array.from_pandas(text, type=pa.string()))))

    held = free_name(docs.withColumns({c: F.lit(0) for c in columns}), "toxicity")
    out = docs.withColumn(held, score(F.col(text_col)))
    return out.withColumn(columns[0], F.col(held)).withColumn(columns[1], (F.col(held) >= 0.5).cast("int")).drop(held)
