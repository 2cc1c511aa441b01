import collections
import hashlib
import itertools

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from conftest import DATA

from gritmill.llm import bpe


def _bag(text):
    words = text.lower().split()
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def test_pipeline(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    tokens = bpe.read_ranks(P.path(bpe.VOCABULARY))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    times = collections.Counter(r.doc_id for r in got)
    assert times and set(times) <= set(texts) and max(times.values()) <= 2
    for r in got:
        assert r.n_tokens == len(e.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    # brute force: of near duplicates, one went on
    bags = {i: _bag(texts[i]) for i in times}
    for a, b in itertools.combinations(sorted(bags), 2):
        n = sum((bags[a] & bags[b]).values())
        assert n / (sum(bags[a].values()) + sum(bags[b].values()) - n) < 0.8


def test_stages_with_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    good = spark.read.parquet(f"{DATA}/documents.parquet")
    long = " ".join(r.text for r in good.select("text").limit(40).collect()) * 5
    odd = [(None, "text without an id at all", "en", "src1", 1), (-1, None, None, None, None), (-2, "", "en", None, 0), (-3, " \n\t", None, "src1", 3), (-4, "12345 !!!", "xx", "", 9), (-5, long, "en", "src1", len(long)), (-6, "é" * 3000, "fr", "src2", 3000)]
    docs = good.unionByName(spark.createDataFrame(odd + odd[-2:], good.schema))
    names = ["id", "score", "rejected", "evidence", "site", "__site", "__mix", "copy", "helper", "key", "rep", "lang_pred", "row", "part"]
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows[:50] for n in names), name
        if name == "language ID":  # what has no letter goes, whole documents stay
            assert not {r.doc_id for r in rows} & {-1, -2, -3, -4} and -5 in {r.doc_id for r in rows}
            assert len({r.doc_id for r in rows if r.doc_id is not None and r.doc_id >= 0}) >= 0.98 * good.count()
        if name == "near-dedup":  # repeated rows are one
            assert collections.Counter(r.doc_id for r in rows)[-5] == 1
    coded = {r.doc_id: r for r in corpus_pipeline.encode_tokens(spark, docs, DATA).collect()}
    assert coded[-1].n_tokens == coded[-2].n_tokens == 0 and coded[-5].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns), name
