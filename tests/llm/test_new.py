import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pytest
from compare import rows as sorted_rows
from conftest import DATA

from gritmill.llm import alignment, negatives, queries, urls
from gritmill.llm.bpe import byte_symbols


# --- 11

def mined(vectors, every=100, scale=256, positives=5, negs=10, low=30, high=90):
    """Brute force over {id: (label, vector)}."""
    q = {i: (label, [int(np.floor(scale * float(x))) for x in v]) for i, (label, v) in vectors.items()}
    out = []
    for a in sorted(i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], v)) for i, (_, v) in q.items() if i != a and len(v) == len(q[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:positives]:
            fits = [i for i in order if q[i][0] != q[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:negs], 1)]
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_negatives_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # few values, so scores tie; a hot label; vectors of two lengths, some with no whole chunk
    vectors = {i: (int(rng.integers(0, 4)) if i % 3 else 9, rng.integers(-2, 6, 70 if i % 11 else 5) / 256) for i in range(400)}
    vectors[13] = (2, np.zeros(70))
    rows = [(i, v.tolist(), label, "x", 0) for i, (label, v) in vectors.items()]
    rows += [rows[7], (500, None, 1, "x", 0), (600, [1.0, None], 1, "x", 0), (700, [float("nan")] * 70, 1, "x", 0), (800, [float("inf")] * 70, 1, "x", 0), (900, [0.5] * 70, None, "x", 0), (None, [0.5] * 70, 1, "x", 0), (1000, [], 1, "x", 0), (1001, [], 1, "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, dim string, rank int")
    vectors |= {1000: (1, []), 1001: (1, [])}
    want = sorted(mined(vectors, every=10))
    assert want and of(negatives.mine(df, every=10)) == want
    monkeypatch.setattr(negatives, "ROWS", 30)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    assert of(negatives.mine(df, every=10, chunk=16)) == want
    assert of(negatives.mine(df.limit(0))) == []


def test_negatives_of_one_id_and_large_scores(spark):
    rows = [(0, [1.0], 1), (0, [2.0], 1), (0, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert of(negatives.mine(df)) == [(0, 1, 1, 2, 65536, 32768)]
    big = spark.createDataFrame([(0, [2.0**40], 1), (1, [2.0**40], 1), (2, [2.0**40], 2)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="may not fit 64-bit"):
        negatives.mine(big).collect()
    x, y = np.array([[1 << 40, -3]]), np.array([[1 << 20, 7], [5, 1]])
    assert negatives.product(x, y).tolist() == [[(1 << 60) - 21, (5 << 40) - 3]]


def test_negatives_query(spark, duck):
    got = queries.QUERIES["op11_negatives"](spark, DATA).toPandas()
    assert len(got) and sorted_rows(got) == sorted_rows(duck.sql(queries.ORACLE_SQL["op11_negatives"]).df())


# --- 12

def aligned(texts):
    """Brute force: whole texts through both libraries, groups token by token, links pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = {c: n for n, c in enumerate(byte_symbols())}
    out, docs = [], collections.Counter()
    for text in texts:
        ia = ib = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        wa = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        wb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(wa) != b"".join(wb) or b"".join(wa) != (" " + text).encode():
            out.append(([], []))
            continue
        ends = [list(itertools.accumulate(map(len, w))) for w in (wa, wb)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in shared]
        for k, ids in enumerate((ia, ib)):
            g = 0
            for i, e in zip(ids, ends[k]):
                groups[g][k].append(i)
                g += e == shared[g]
        links = [(x, y) for u, v in groups for x in u for y in v]
        docs.update(set(links))
        out.append((groups, links))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    show = lambda ids: ",".join(map(str, ids))
    return [(
        sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
        hashlib.sha256(";".join(f"{show(u)}|{show(v)}" for u, v in g).encode()).hexdigest() if g else "",
    ) for g, links in out]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "plain words, here.", "plain words, here.", None, "", " ", "  ", "a ", " a", "a  b", "a\nb", "a\n b \n\n c", "tab\tand\u00a0wide\u3000space end", "x\u001cy \u001c z",
    "<|endoftext|> <s> </s> <unk> <0x41> it's we'll", "a\u2581b", "日本語のテキスト 😀😀 é e\u0301 \u200b", "naïve café — “quoted” … 12345 3.14 $x$", "\x00\x01 \x7f", "\ufeffbom", "a" * 5000, "ab1-" * 3000, "0" * 300 + " x", "word " * 3000,
]


def test_segments():
    assert alignment.segments("a b") == ["a", "b"]
    assert alignment.segments("a  b ") == ["a", " b", ""]
    assert alignment.segments(" a\n b") == [" a\n b"]
    for t in filter(None, ODD):
        assert " " + t == "".join(" " + s for s in alignment.segments(t))


@pytest.mark.parametrize("case", ["plain", "small"])
def test_alignment_against_brute_force(spark, monkeypatch, case):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs int").repartition(3)
    if case == "small":  # most pairs are joined
        monkeypatch.setattr(alignment, "FREQUENT", 300)
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in alignment.align(df).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(aligned(texts)):
        assert got[i if i != 3 else None] == w, texts[i]
    if case == "plain":
        assert alignment.align(df.limit(0)).collect() == []


def test_wide_groups_and_forgetting(monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 1)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    lexicon = alignment.Lexicon(alignment.Tokens(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")))
    texts = [t for t in ODD if t]
    got = [x for t in texts for x in lexicon.align([t])]
    for (*numbers, digest, keys, times), w in zip(got, [aligned([t])[0] for t in texts]):
        assert (*numbers, digest) == (*w[:4], w[6]) and times.sum() == w[3] and len(keys) == len(set(keys.tolist()))


def test_counts_are_passed_on_when_too_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "HELD", 2)
    pairs = [np.array(x, "<i8").tobytes() for x in ([1, 2, 3], [2, 3, 4], [3], [])] + [None]
    total = collections.Counter()
    for b in alignment._held([pa.RecordBatch.from_arrays([pa.array([p], pa.binary())], names=["pairs"]) for p in pairs]):
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if b.num_rows else {})
    assert total == {1: 1, 2: 2, 3: 3, 4: 1}


# --- 13

URLS = [
    "http://example.net/en/1", "http://EXAMPLE.net/de/", "https://a.b.Example.NET/en/x?y#z", "http://example.net", "http://example.net?x=/en/", "https://example.com/de/", "https://x.example.com/de",
    "http://notexample.com/de/1", "http://m.org/fr/?q", "org/fr/", "", None, "://", "http://", "file:///fr/", "a://b://net/", "http://net:80/", "http://ÄB.org/fr/ü", "http://x.org\n/fr/\n", "HTTP://u@Org/fr/", "http://x.net/en/",
]


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:ends]), rest[ends:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("per_file", [1, 3, 100])
def test_urls_against_brute_force(spark, per_file):
    rules = [*queries.RULES, ("block", "b.net", "/"), ("allow", "net", "/ab"), ("block", "ÄB.org".lower(), "/fr/"), ("block", "Äb.org", "/fr/ü")]
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, "http://b.net/ab", "http://c.net/abc"])] + [(None, "http://net/", "x", "y"), (1, URLS[1], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(df, iter(rules), per_file=per_file, default="block")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *judged(u, rules, "block"))) for i, u, *_ in rows)
    assert urls.judge(df.limit(0), rules).collect() == [] and {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError, match="starts with a slash"):
        urls.judge(df, [("block", "net", "x")])


def test_equal_digests_are_told_apart():
    same = lambda names: np.full(len(names), 7, np.uint64)
    keys = urls.Keys.build({"a": [1], "b": [2, 3], "": [4]}, same)
    assert keys.find(["b", "c", "a", ""], same) == [[2, 3], None, [1], [4]]
    assert urls.Keys.build({}).find(["a"]) == [None]


def test_urls_query(spark, duck):
    got = queries.QUERIES["op13_urls"](spark, DATA).toPandas()
    assert set(got.verdict) == {"allow", "block"} and sorted_rows(got) == sorted_rows(duck.sql(queries.ORACLE_SQL["op13_urls"]).df())
