"""Quality classifier: a document classifier's evidence combined with host and path posteriors by empirical Bayes.

1. A document classifier is trained in numpy on a bounded sample of labelled rows. It learns a log-odds for each hashed
   word (shrunk counts, taken from the other half of the sample for a row that is trained on) and a small network over a
   text's mean and extreme word log-odds and its shape (shares of symbols, capitals, digits and spaces, repeated lines,
   distinct words' share, length). It gives the log-likelihood ratio of "good" against "bad" for the text alone, the
   training prior taken out.
2. Grouped aggregation counts documents and expected good documents for each host and each (host, path). The strength
   of each level's Beta prior is the method-of-moments estimate from the spread of the groups below it; a host's rate is
   shrunk to the global rate, a path's rate to its host's, so that sparse sites stay near the global prior.
3. The posterior of a document is its evidence plus the log-odds of its path's rate, both levels counted without the
   document itself, so that no document's evidence counts twice.

Host and path come from the source column: ``host/first/...`` or a URL gives its host and its first path segment; a
bare name is a host, and then the language is the section (sites keep languages under paths such as ``/en/``).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Workspace, blocks, buffer_of, free_name, texts, tune
from .minhash import word_hashes
from .sampling import labelled_sample

PER_LABEL = 2500
#: Columns that judged rows have.
RESULTS = ("evidence", "site_log_odds", "score", "rejected")
#: A document is rejected if its posterior of being good is below this.
REJECT_BELOW = 0.5
#: Buckets of hashed words, and the weight of the prior in a word's log-odds.
WORD_BITS = 16
WORD_PRIOR = 2.0
#: The log-odds that a site can add are bounded so that no site decides alone.
SITE_LIMIT = 4.0

_CLASSES = 7
_KIND = np.zeros(256, np.int64)  # 0 letters and bytes over 127, 1 capitals, 2 digits, 3 spaces, 4 line ends, 5 prose marks, 6 symbols
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.isupper() else 0 if _s.isalpha() else 2 if _s.isdigit() else 4 if _s == "\n" else 3 if _s.isspace() else 5 if _s in ".,;:'\"-()?" else 6
FEATURES = 13
#: With the word log-odds: their mean, their least and their largest mean over stretches of the text.
ALL = FEATURES + 3
_STRETCH = 32


def word_ids(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts, and its row."""
    data, offsets = buffer_of(pc.utf8_lower(array))
    ids, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a, b in blocks(offsets):
        h, row = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ids.append((h >> np.uint64(64 - WORD_BITS)).astype(np.int32))
        rows.append(row + a)
    return np.concatenate(ids), np.concatenate(rows)


def word_odds(ids: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log-odds of each bucket: in what share of good and of bad rows it occurs, shrunk to nothing where rare."""
    seen = np.unique(row.astype(np.int64) << WORD_BITS | ids)
    bucket, label = seen & ((1 << WORD_BITS) - 1), y[seen >> WORD_BITS]
    good, bad = (np.bincount(bucket[label == v], minlength=1 << WORD_BITS) for v in (1, 0))
    of_good, of_bad = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    share = (good + bad) / (of_good + of_bad)
    return np.log((good + WORD_PRIOR * share + 1e-9) / (of_good + WORD_PRIOR) / ((bad + WORD_PRIOR * share + 1e-9) / (of_bad + WORD_PRIOR))).clip(-4, 4)


def lexical(ids: np.ndarray, row: np.ndarray, rows: int, odds: np.ndarray) -> np.ndarray:
    """rows x 3: mean log-odds of a text's words, and the least and largest mean over stretches of it; 0 without words."""
    value, n = odds[ids], np.bincount(row, minlength=rows)
    out = np.zeros((rows, 3))
    out[:, 0] = np.bincount(row, value, minlength=rows) / np.maximum(n, 1)
    if len(value):
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        begin = np.flatnonzero(place % _STRETCH == 0)
        mean = np.add.reduceat(value, begin) / np.diff(np.append(begin, len(value)))
        own = row[begin]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first], 1], out[own[first], 2] = np.minimum.reduceat(mean, first), np.maximum.reduceat(mean, first)
    return out


def features(array: pa.Array) -> np.ndarray:
    """rows x FEATURES: numbers about the shape of whole texts, each between 0 and about 3; zeros for empty texts."""
    data, offsets = buffer_of(array)
    out = [np.zeros((0, FEATURES))]
    for a, b in blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        rows, size = b - a, np.diff(own)
        kinds = np.zeros(rows * _CLASSES, np.int64)
        for p in range(0, len(part), BLOCK_BYTES):
            piece = part[p : p + BLOCK_BYTES]
            inside = np.clip(own, p, p + len(piece))
            kinds += np.bincount(np.repeat(np.arange(rows), np.diff(inside)) * _CLASSES + _KIND[piece], minlength=len(kinds))
        kinds = kinds.reshape(rows, _CLASSES)
        n = np.maximum(size, 1)[:, None]
        h, at = word_hashes(part, own)
        words = np.bincount(at, minlength=rows)
        order = np.lexsort((h, at))
        hs, rs = h[order], at[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        distinct = np.bincount(rs[new], minlength=rows)
        # lines, by a hash of their bytes: how many repeat
        lines, repeated = 1.0 + kinds[:, 4], np.zeros(rows)
        for r in np.flatnonzero(kinds[:, 4] > 0):
            text = part[own[r] : own[r + 1]].tobytes().split(b"\n")
            repeated[r] = len(text) - len(set(text))
        share = kinds / n
        w = np.maximum(words, 1)
        mean = size / w
        out.append(
            np.column_stack(
                [
                    share[:, 1],
                    share[:, 2],
                    share[:, 3],
                    np.minimum(share[:, 4] * 20, 3),
                    share[:, 5] * 5,
                    np.minimum(share[:, 6] * 5, 3),
                    np.minimum(kinds[:, 6] / w, 3),
                    np.minimum(kinds[:, 1] / w, 3),
                    distinct / w,
                    repeated / lines,
                    np.log1p(words) / 5,
                    np.minimum(mean / 10, 3),
                    (words == 0).astype(float),
                ]
            )
        )
    return np.concatenate(out)


@dataclasses.dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float  # includes the training prior taken out
    odds: np.ndarray

    def evidence(self, array: pa.Array) -> np.ndarray:
        """The log-likelihood ratio of good against bad, within +-12."""
        x = (np.hstack([features(array), lexical(*word_ids(array), len(array), self.odds)]) - self.mean) / self.scale
        return np.clip(np.tanh(x @ self.hidden + self.offset) @ self.out + self.bias, -12, 12)


def train(rows: list[tuple[str, int]], seed: int = 5, units: int = 16, epochs: int = 400) -> QualityModel:
    """Word log-odds and a small network of one layer, fitted by Adam in numpy. One label only: no evidence either way."""
    y = np.array([int(v) for _, v in rows], np.float64)
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(ALL), np.ones(ALL), np.zeros((ALL, units)), np.zeros(units), np.zeros(units), 0.0, np.zeros(1 << WORD_BITS))
    array = pa.array([t for t, _ in rows])
    ids, row = word_ids(array)
    half = rng.permutation(len(rows)) % 2
    words = np.zeros((len(rows), 3))
    for k in (0, 1):  # a row's words are judged by the other half
        other = half[row] != k
        odds = word_odds(ids[other], row[other], np.where(half != k, y, -1))
        words[half == k] = lexical(ids, row, len(rows), odds)[half == k]
    x = np.hstack([features(array), words])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    p = [rng.normal(0, 0.3, (ALL, units)), np.zeros(units), rng.normal(0, 0.3, units), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, epochs + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y) / len(y)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            p[i] = p[i] - 0.03 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    prior = np.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(mean, scale, p[0], p[1], p[2], float(p[3][0] - prior), word_odds(ids, row, y))


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, learn=None) -> tuple[QualityModel, float]:
    """The model, trained on at most about ``per_label`` labelled documents of each label, and the rate of good ones
    among all labels (smoothed). ``learn`` may hold rows back by a condition on id."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    rate = ((total["good"] or 0) + 1.0) / (total["n"] + 2.0)
    plain = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return labelled_sample(plain, known, per_label, "quality", train), rate


def with_evidence(docs: DataFrame, model: QualityModel, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", name: str = "evidence") -> DataFrame:
    """Adds a struct: the text's evidence, its host and its path. Null sources are the host "", null languages the path
    "". Null and empty texts are judged by the features of an empty text."""
    cast = tune(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(text):
        import pandas as pd

        return pd.Series(cast.value.evidence(texts(pa.Array.from_pandas(text, type=pa.string()))))

    bare = F.regexp_replace(F.coalesce(F.col(source_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    section = F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0))
    path = F.when(section != "", section).otherwise(F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    return docs.withColumn(name, F.struct(evidence(F.col(text_col)).alias("e"), host.alias("host"), path.alias("path")))


def expected(evidence: F.Column, prior: float) -> F.Column:
    """The chance that a document of this evidence is good, before its site is known."""
    return 1 / (1 + F.exp(-(evidence + F.lit(float(np.log(prior / (1 - prior)))))))


def site_counts(scored: DataFrame, ws: Workspace, prior: float, name: str = "evidence") -> tuple[DataFrame, float, float, float]:
    """(host, path, n, k, hn, hk): documents and expected good ones of each path and its host; and the global rate and the
    strengths of the priors of hosts and paths. The number of rows is that of the sites, a few numbers reach the driver."""
    e = F.col(name)
    paths = ws.cut(scored.groupBy(e["host"].alias("host"), e["path"].alias("path")).agg(F.count("*").cast("double").alias("n"), F.sum(expected(e["e"], prior)).alias("k")), "paths")
    hosts = ws.cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk")), "hosts")

    def strength(t: DataFrame, n, k, mu) -> float:
        """Method of moments for the Beta prior: between-group variance beyond the binomial one, weighted by size."""
        r = t.agg(
            F.sum(n).alias("n"),
            F.sum(n * n).alias("n2"),
            F.sum(n * (k / n - mu) * (k / n - mu)).alias("ss"),
            F.sum(mu * (1 - mu) * n).alias("v"),
            F.count("*").alias("g"),
        ).first()
        if not r["n"] or r["g"] < 2:
            return 100.0
        var = r["v"] / r["n"]
        between = (r["ss"] - (r["g"] - 1) * var) / max(r["n"] - r["n2"] / r["n"], 1e-9)
        return float(min(max(var / between - 1 if between > 1e-9 else 1e4, 1.0), 1e4))

    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k")).first()
    mu = (total["k"] + 1) / (total["n"] + 2) if total["n"] else prior
    of_hosts = strength(hosts, F.col("hn"), F.col("hk"), F.lit(mu))
    both = ws.cut(paths.join(hosts, "host"), "sites")
    of_paths = strength(both, F.col("n"), F.col("k"), (F.col("hk") + mu * of_hosts) / (F.col("hn") + of_hosts))
    return both, float(mu), of_hosts, of_paths


def judge(scored: DataFrame, ws: Workspace, prior: float, reject_below: float = REJECT_BELOW, name: str = "evidence") -> DataFrame:
    """Replaces the struct of :func:`with_evidence` by evidence, site_log_odds, score and rejected. The site's rate counts
    all its documents but the row itself. The join is a plain one: the planner broadcasts a small table of sites and splits
    the rows of a hot site otherwise."""
    sites, mu, of_hosts, of_paths = site_counts(scored, ws, prior, name)
    s = free_name(scored, "site")
    e, of = F.col(name), F.col(s)
    joined = scored.join(sites.select(F.struct("host", "path", "n", "k", "hn", "hk").alias(s)), (e["host"] == of["host"]) & (e["path"] == of["path"]))
    own = expected(e["e"], prior)
    host = (of["hk"] - own + mu * of_hosts) / (of["hn"] - 1 + of_hosts)
    rate = (of["k"] - own + host * of_paths) / (of["n"] - 1 + of_paths)
    rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    site = F.least(F.greatest(F.log(rate / (1 - rate)), F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    score = 1 / (1 + F.exp(-(e["e"] + site)))
    keep = [F.col(f"`{c}`") for c in scored.columns if c != name and c.lower() not in RESULTS]
    return joined.select(*keep, e["e"].alias("evidence"), site.alias("site_log_odds"), score.alias("score"), (score < reject_below).alias("rejected"))


def classify(docs: DataFrame, model: QualityModel, prior: float, text_col: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """Adds evidence, site_log_odds, score (posterior of good) and rejected to all rows; existing columns of these
    names are replaced, others stay. Repeated rows count each. An empty table gives an empty one. The rows are written
    once with their evidence, so that texts are read by the model once."""
    name = free_name(docs, "evidence_")
    ws = Workspace(docs.sparkSession, "quality")
    return judge(ws.cut(with_evidence(docs, model, text_col, name=name), "scored"), ws, prior, reject_below, name)
