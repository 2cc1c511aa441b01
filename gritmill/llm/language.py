"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased, every ASCII character that is no letter becomes a space, and all byte n-grams of 2 to 4 bytes
are hashed into buckets; a document is the mean of its buckets' embeddings, a linear softmax gives the languages. As
the model is linear, scoring needs one table of buckets x languages and runs over whole texts in vectorised blocks.
Rejection is calibrated: a temperature is fitted on rows kept back from training, and a text is rejected if the
calibrated probability of its best language is below the bound that best tells the whole texts kept back from the same
texts with all their letters shuffled. To lose a text weighs as much as to let ``KEEP`` shuffled ones pass.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, buffer_of, crc_of, free_name, texts, tune
from .sampling import sample_rows

UNKNOWN = "und"
BUCKETS_LOG2 = 15
DIM = 16
SIZES = (2, 3, 4)
#: Training rows of each language at most.
PER_LANGUAGE = 800
#: How many shuffled texts may pass for each whole text that is kept.
KEEP = 100

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def ngram_ids(data: np.ndarray, bits: int):
    """For n in SIZES: (bucket, valid) of the n-gram that starts at each byte. Those that start with two spaces are none."""
    h = data.astype(np.uint32)
    gap = data == 32
    twice = gap[:-1] & gap[1:]
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n in SIZES:
            yield (h + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits), ~twice[: len(h)]


def _padded(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer_of(pc.binary_join_element_wise(" ", pc.utf8_lower(array), " ", ""))
    return _LETTERS[data], offsets


def _sums(data, offsets, table):
    """Per row: the sum of the table's rows over its n-grams, and their number. A row longer than a block is taken in
    pieces that overlap by an n-gram."""
    rows = len(offsets) - 1
    if rows == 1 and len(data) > BLOCK_BYTES:
        out, count = np.zeros((1, table.shape[1])), np.zeros(1)
        for p in range(0, len(data), BLOCK_BYTES):
            part = data[p : p + BLOCK_BYTES + max(SIZES) - 1]
            more, n = _block_sums(part, np.array([0, len(part)]), table, BLOCK_BYTES)
            out, count = out + more, count + n
        return out, count
    return _block_sums(data, offsets, table, len(data))


def _block_sums(data, offsets, table, limit):
    """As _sums, of the n-grams that start before ``limit``."""
    rows = len(offsets) - 1
    out, count = np.zeros((rows, table.shape[1])), np.zeros(rows)
    for ids, valid in ngram_ids(data, int(np.log2(len(table) - 1))):
        # an n-gram that reaches into the next row counts for neither
        room = np.minimum(offsets[1:] - (len(data) - len(ids)), len(ids))
        owner_end = np.maximum(room, offsets[:-1])
        mask = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mask, np.minimum(offsets[:-1], len(ids)), 1)
        np.add.at(mask, np.minimum(owner_end, len(ids)), -1)
        good = valid & (np.cumsum(mask[:-1]) > 0)
        good[limit:] = False
        ids = np.where(good, ids, len(table) - 1)
        at = np.minimum(offsets[:-1], len(ids) - 1)
        out += np.add.reduceat(table[ids], at, axis=0, dtype=np.float64)
        count += np.add.reduceat(good.astype(np.int64), at)
    return out, count


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets + 1 rows of logits, the last one zero
    bias: np.ndarray
    temperature: float
    threshold: float
    lost: float = 0.0  # share of the whole texts kept back that the bound rejects
    passed: float = 1.0  # share of the shuffled ones that it lets pass

    def probabilities(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the calibrated probabilities of the languages, and whether it has a letter."""
        probs, lettered = [np.zeros((0, len(self.languages)))], [np.zeros(0, bool)]
        data, offsets = _padded(array)
        for a, b in blocks(offsets):
            part = data[offsets[a] : offsets[b]]
            sums, count = _sums(part, offsets[a : b + 1] - offsets[a], self.table)
            z = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            probs.append(z / z.sum(axis=1, keepdims=True))
        lettered.append(pc.match_substring_regex(array, r"\p{L}").to_numpy(zero_copy_only=False))
        return np.concatenate(probs), np.concatenate(lettered).astype(bool)


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 12, batch: int = 64, rate: float = 20.0, bits: int = BUCKETS_LOG2) -> LanguageModel:
    """Fits the embeddings and the softmax jointly. Every fifth row is kept back for the calibration. Besides whole
    texts, pieces of them are learned, so that short texts are known too. Without rows the model knows no language."""
    rng = np.random.default_rng(seed)
    languages = sorted({label for _, label in rows})
    size = 1 << bits
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((size + 1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    pieces, labels, held = [], [], []
    for k, (text, label) in enumerate(rows):
        words = text.split()
        cuts = [text]
        for n in (3, 10):
            if len(words) > n:
                at = int(rng.integers(0, len(words) - n))
                cuts.append(" ".join(words[at : at + n]))
        pieces += cuts
        labels += [languages.index(label)] * len(cuts)
        held += [k % 5 == 4] * len(cuts)
    y, held = np.array(labels), np.array(held)
    if held.all() or not held.any():
        held[:] = False
    bags = []
    for text in pieces:
        data, _ = _padded(pa.array([text]))
        ids = [i[v] for i, v in ngram_ids(data, bits)]
        bags.append(np.unique(np.concatenate(ids) if ids else np.zeros(0, np.uint32), return_counts=True))
    e = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    fit = np.flatnonzero(~held)

    def dense(part):
        x = np.zeros((len(part), size), np.float32)
        for i, k in enumerate(part):
            ids, n = bags[k]
            x[i, ids] = n / max(1, n.sum())
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = dense(part)
            hidden = x @ e
            z = hidden @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ w.T
            w -= 0.1 * step * (hidden.T @ p)
            bias -= 0.01 * step * p.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            e[used] -= step * (x[:, used].T @ back)
    table = np.zeros((size + 1, len(languages)), np.float32)
    table[:size] = e @ w
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else fit
    probs, _ = model.probabilities(pa.array([pieces[k] for k in check]))
    logp, truth = np.log(np.maximum(probs, 1e-12)), y[check]

    def loss(t):
        z = logp / t
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -z[np.arange(len(truth)), truth].mean()

    model.temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
    back = [text for k, (text, _) in enumerate(rows) if k % 5 == 4] or [text for text, _ in rows]
    best = lambda texts_: model.probabilities(pa.array(texts_, pa.string()))[0].max(axis=1)
    model.threshold, model.lost, model.passed = bound(best(back), best([shuffled(t, rng) for t in back]))
    return model


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order, all else in place."""
    chars = np.array(list(text), dtype=object)
    at = np.flatnonzero([c.isalpha() for c in chars])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars)


def bound(genuine: np.ndarray, nonsense: np.ndarray) -> tuple[float, float, float]:
    """The smallest bound of least cost, and the shares of genuine scores below it and of nonsense at or above it."""
    places = np.unique(np.concatenate(([0.0], genuine, nonsense, nonsense + 1e-9)))
    lost = np.searchsorted(np.sort(genuine), places) / max(1, len(genuine))
    passed = 1 - np.searchsorted(np.sort(nonsense), places) / max(1, len(nonsense))
    k = int(np.argmin(KEEP * lost + passed))
    return float(places[k]), float(lost[k]), float(passed[k])


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, learn=None) -> LanguageModel:
    """Trains on a sample of at most about ``per_language`` documents of each language, each row with its own label; rows
    whose crc32(doc_id as text) mod 4 is 2 are never learned from. ``learn`` may replace that condition on id."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    return sample_rows(rows.where(crc_of(F.col("id")) % 4 != 2 if learn is None else learn), per_language, "language", train)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language (``und`` for null texts and texts without a letter), its calibrated probability
    (0 for ``und``) and whether the text is rejected. Existing columns of these names are replaced; all others stay.
    The text alone decides: equal texts get equal results. An empty table gives an empty one."""
    spark = tune(docs.sparkSession)
    cast = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(text):
        import pandas as pd

        m = cast.value
        probs, lettered = m.probabilities(texts(pa.Array.from_pandas(text, type=pa.string())))
        best = probs.argmax(axis=1)
        score = np.where(lettered, probs[np.arange(len(best)), best], 0.0)
        names = np.where(lettered, np.array(m.languages, dtype=object)[best], UNKNOWN)
        return pd.DataFrame({"lang_pred": names, "score": score, "rejected": ~lettered | (score < m.threshold)})

    held = free_name(docs.withColumns({c: F.lit(0) for c in columns}), "language")
    out = docs.withColumn(held, predict(F.col(text_col)))
    for name, field in zip(columns, ("lang_pred", "score", "rejected")):
        out = out.withColumn(name, F.col(held)[field])
    return out.drop(held)
