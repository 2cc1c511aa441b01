import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from gritmill.llm import bpe, caps, chunking, language, minhash, mixing, packing, quality, sampling, toxicity, warc
from gritmill.llm.components import components
from gritmill.llm.common import Workspace

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "!!! 123", "fr", None, 7),
    (6, LONG, "en", "b", 9),
    (7, "ein kurzer text", "de", "a", 2),
    (None, "text without an id", "en", "a", 3),
    (7, "ein kurzer text", "de", "a", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in ("id", "score", "rejected", "key", "a", "b", "size", "taken", "lang_pred", "evidence", "data", "rep", "component")])


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 3), (None, 1)], "a long, b long")
    got = dict(map(tuple, components(e, Workspace(spark, "t")).collect()))
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    assert components(e.limit(0), Workspace(spark, "t")).count() == 0


def test_near_duplicates_edge_cases(spark, docs, clash):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, None: None}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(clash).collect()} == got
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "y"), (3, "", "x"), (3, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = collections.Counter((r.doc_id, r.class_id, r.n_words, r.kept) for r in minhash.near_duplicates(df).collect())
    want = [(1, 1, 40, True), (1, 1, 40, True), (2, 1, 40, False), (None, 1, 40, False), (None, None, 40, True), (3, 3, 0, True), (None, None, 0, True)]
    assert got == collections.Counter(want)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (3, ""), (None, "")], key=str)
    assert sorted(map(str, minhash.drop_near_duplicates(df).collect())) == sorted(map(str, minhash.drop_near_duplicates(df).collect()))


def test_kernels_work_in_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    rows = ["".join(rng.choice(list("ab  \n"), int(rng.integers(0, 60)))) for _ in range(40)] + ["x" * 70]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in rows])
    whole = minhash.shingles(data, offsets)
    sig = minhash.signatures(*whole[:3], len(rows))
    h, row = minhash.word_hashes(data, offsets)
    assert list(row) == [r for r, t in enumerate(rows) for _ in t.split()]
    assert len(set(h.tolist())) == len({w for t in rows for w in t.split()})
    for size in (1, 3, 16):
        monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
        monkeypatch.setattr(minhash, "POINTS", 7)
        again = minhash.shingles(data, offsets)
        assert all((x == y).all() for x, y in zip([*whole[:3], *whole[3]], [*again[:3], *again[3]]))
        assert (minhash.signatures(*again[:3], len(rows)) == sig).all()


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(6):
        base = list(rng.choice(words, 120))
        for k in range(40):
            own = list(base)
            for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
                own[at] = str(rng.integers(1 << 40))
            rows.append((g * 100 + k, " ".join(own)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = {i: collections.Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = sum((bags[a] & bags[b]).values())
            if n / (sum(bags[a].values()) + sum(bags[b].values()) - n) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    order = np.argsort(keys)
    row = np.repeat([0, 1], 300)
    sig = minhash.signatures(row, np.concatenate((keys[order], keys[order])), np.concatenate((wa[order], wb[order])), 2, 2000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    x[100:200] = x[0:100] + rng.normal(size=(100, 32)) * 0.2
    x[200:220] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, []), (905, [1.0, 2.0]), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    assert [got[i][0] for i in range(400)] == (s.sum(axis=1) - 1).tolist()
    assert all(got[i] == (0, i) for i in range(900, 906))
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_media_round_trip(spark, docs, clash):
    got = chunking.media_of(docs).collect()
    assert len(got) == len(DOCS) == chunking.media_of(clash).count()
    want = collections.Counter()
    for i, t, *_ in DOCS:
        p = chunking.padded((t or "").encode())
        m = chunking.header(len(p)) + p
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), chunking.features(p)] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert chunking.media_of(docs.limit(0)).count() == 0


def test_chunks_cover_payloads():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 255, 40_000).astype(np.uint8).tobytes()
    payloads = [shared, b"head" * 100 + shared, b""]
    ends = chunking.cuts(payloads)
    pieces = [[p[a:b] for a, b in zip([0, *e], e)] for p, e in zip(payloads, ends)]
    assert [b"".join(x) for x in pieces] == payloads
    assert len(set(pieces[0]) & set(pieces[1])) >= len(pieces[0]) - 2


def test_warc(spark):
    html = "<p>" + "x" * 200
    rows = [(1, "http://a/ b", html), (2, None, html), (3, "u", None), (4, "u", "tiny"), (5, "u", "tiny"), (None, "u", html), (1 << 62, "u", html), (2, None, html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df, shard_bytes=300, roll=200).collect()), key=str)
    first = lambda i, h: (i, len(h), hashlib.sha256(h.encode()).hexdigest(), "response", None)
    later = lambda i: (i, len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit", 1)
    assert got == sorted([first(1, html), later(2), later(2), later(None), later(1 << 62), first(3, ""), first(4, "tiny"), first(5, "tiny")], key=str)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_decides_by_payload_when_an_id_repeats(spark):
    a, b, c, own = ("<p>" + x * 200 for x in "abco")
    rows = [(1, "u", a), (2, "u", b), (9, "u", a), (9, "u", b), (9, "u", c), (9, "u", "tiny"), (9, "u", own), (9, "u", None), (10, "u", own)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in warc.archive(df, shard_bytes=300, roll=200).collect()}
    key = lambda i, h: (i, hashlib.sha256((h or "").encode()).hexdigest())
    want = {key(i, h): ("response", None) for i, _, h in rows}
    want |= {key(9, a): ("revisit", 1), key(9, b): ("revisit", 2), key(10, own): ("revisit", 9)}
    assert got == want


def test_bpe_equals_tiktoken(spark, docs):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path(bpe.VOCABULARY))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(bpe.serialise(tokens), P.PATTERN)
    cases = [" ", "a ", " a", "a b ", "a\n b", "a \nb", "a\u3000 b c", "a\x1c b", "it's I'll  two", "x, y.\nz w\n\nv", "", "  a", "x  \n\n y", "日本 😀", "a" * 500, "<unk> ▁", "I'll ١٢ 1234 !?", "\x00\x1c \x85", "".join(map(chr, range(0x250)))]
    for t, packed in zip(cases, codec.encode(cases)):
        assert np.frombuffer(packed, "<u4").tolist() == e.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()
    got = bpe.digest(docs).collect()
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in DOCS)
    back = bpe.decode(bpe.encode(docs)).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_mixing(spark, docs, clash):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and mixing.mix(clash).columns == [*clash.columns, "__mix"]
    for r in got:
        assert r["__mix"].size == len(re.findall(mixing.WORD, r.text or "")) and r["__mix"].taken <= 2 * r["__mix"].size
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, mixing.mixed_rows(docs).collect())) == sorted(map(str, mixing.mixed_rows(docs).collect()))


def test_targets_and_flow():
    assert mixing.quotas({"a": 10, "b": 100, None: 50}) == {"a": 20.0, "b": 120.0, None: 100.0}
    f = mixing.route({("a", "b"): 10, ("a",): 5, ("b",): 100}, {"a": 12, "b": 120})
    assert sum(f["a", "b"].values()) <= 20 and f["a",].get("a", 0) + f["a", "b"].get("a", 0) == 12 and f["b",]["b"] + f["a", "b"]["b"] == 120


def test_taken_words_come_near_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 5}" if i % 3 else "hot") for i in range(4000)]
    by = collections.defaultdict(lambda: [0, 0])
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source][0] += r["__mix"].taken
        by[r.source][1] = r["__mix"].target
    assert all(abs(t - g) <= 120 for t, g in by.values())


def test_packing(spark, docs):
    from pyspark.sql import functions as F
    from gritmill.llm.common import scratch

    data = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    root = scratch(spark, "packed")
    report = packing.pack(data, root, length=64)
    rows = report.collect()
    assert all(r.n_tokens <= 64 and r.cu_lengths[-1] == r.n_tokens for r in rows)
    back = collections.defaultdict(list)
    for r in packing.unpack(spark, root, report).collect():
        back[r.id].append((r.piece, bytes(r.data)))
    for i, t, *_ in DOCS:
        pieces = sorted(set(back.get(i, [])))
        assert b"".join(p for _, p in pieces) == (t or "").encode()
    assert packing.pack(data.limit(0)).count() == 0


def test_packing_of_token_ids(spark, docs):
    from gritmill.llm.common import scratch

    root = scratch(spark, "packed")
    report = packing.pack(bpe.pack(docs.select("doc_id", "text")), root, dtype="<u2", length=128, pad=0xFFFF)
    back = collections.defaultdict(dict)
    for r in packing.unpack(spark, root, report, dtype="<u2").collect():
        back[r.id][r.piece] = np.frombuffer(bytes(r.data), "<u2").astype("<u4")
    want = {r.doc_id: r.ids for r in bpe.encode(docs).collect() if r.ids}
    assert {i: np.concatenate([p[k] for k in sorted(p)]).tolist() for i, p in back.items()} == {i: list(x) for i, x in want.items()}


def test_best_fit_against_scanning_all_rows():
    rng = np.random.default_rng(11)
    for _ in range(30):
        lengths, length = rng.integers(1, 50, 60).tolist(), 64
        open_, want = [], [0] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [room for room in open_ if room >= lengths[k]]
            if fits:
                open_[open_.index(min(fits))] -= lengths[k]
            else:
                open_.append(length - lengths[k])
        rows = packing.best_fit(lengths, length)
        left = collections.Counter(length - sum(n for n, r in zip(lengths, rows) if r == row) for row in set(rows))
        assert left == collections.Counter(open_)


def test_digests_equal_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path(bpe.VOCABULARY))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in bpe.digest(table, ids=True).collect()}
    for i, t in table.collect():
        ids = np.array(e.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, bytes(got[i].ids)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), ids)


def test_best_fit():
    rows = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert rows[0] == rows[2] and rows[1] == rows[3] == rows[4] and max(rows) == 1


def _prose(rng, stems, n):
    return " ".join("".join(rng.choice(stems, int(rng.integers(1, 4)))) for _ in range(n))


def test_language(spark, docs, clash):
    rng = np.random.default_rng(5)
    stems = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ich", "ß"], "fr": ["eau", "qu", "é", "oi"]}
    rows = [(_prose(rng, s, 40), k) for _ in range(60) for k, s in stems.items()]
    m = language.train(rows, epochs=6)
    import pyarrow as pa

    test = [(_prose(rng, s, 30), k) for _ in range(20) for k, s in stems.items()]
    p, _ = m.probabilities(pa.array([t for t, _ in test]))
    assert np.mean([m.languages[i] == k for i, (_, k) in zip(p.argmax(axis=1), test)]) > 0.95
    got = {str(r.doc_id) + str(r.text)[:9]: r for r in language.identify(docs, m).collect()}
    assert got["3None"].lang_pred == got["4"].lang_pred == got["5!!! 123"].lang_pred == "und"
    assert language.identify(docs.limit(0), m).count() == 0 and language.identify(clash, m).count() == len(DOCS)
    assert language.train([]).languages == ["und"]


def test_toxicity_finds_misspellings(spark, docs, clash):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    stems = ["th", "ing", "er", "on", "sa", "ble"]
    bad = ["wretched", "vermin", "imbecile"]
    rows = []
    for k in range(300):
        words = _prose(rng, stems, 60).split()
        if k % 3 == 0:
            words[int(rng.integers(60))] = str(rng.choice(bad))
        rows.append((" ".join(words), int(k % 3 == 0)))
    m = toxicity.train(rows, turns=4)
    clean = m.scores(pa.array([_prose(rng, stems, 60) for _ in range(30)]))
    toxic = m.scores(pa.array([_prose(rng, stems, 30) + f" {w} " + _prose(rng, stems, 30) for w in ("wretched", "verminn", "imbecilee")]))
    assert toxic.min() > np.quantile(clean, 0.9)
    s = [r.score for r in toxicity.score_toxicity(docs, m).collect()]
    assert all(0 <= x <= 1 for x in s) and toxicity.score_toxicity(docs.limit(0), m).count() == 0
    assert toxicity.score_toxicity(clash, m).count() == len(DOCS)
    assert toxicity.train([("a", 0)]).scores(pa.array(["b", ""])).max() < 0.5


def test_embeddings_have_more_than_one_direction():
    rng = np.random.default_rng(6)
    rows = [(" ".join([_prose(rng, ["th", "ing", "er"], 20), *(["vermin"] * (k % 2))]), k % 2) for k in range(200)]
    m = toxicity.train(rows, turns=3, bits=12)
    values = np.linalg.svd(m.embeddings - m.embeddings.mean(axis=0), compute_uv=False)
    assert values[1] > 0.05 * values[0] and values[4] > 0.01 * values[0]


def test_quality(spark, docs, clash):
    rng = np.random.default_rng(7)
    rows = [(_prose(rng, ["th", "ing"], 50), 1) for _ in range(80)] + [(_prose(rng, ["th", "$$$", "!!"], 50), 0) for _ in range(40)]
    m = quality.train(rows, epochs=200)
    out = {str(r.doc_id): r for r in quality.classify(docs, m, 0.8).collect()}
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out.values())
    assert quality.classify(docs.limit(0), m, 0.8).count() == 0 and quality.classify(clash, m, 0.8).count() == len(DOCS)
    words_only = quality.train([(f"alpha {w} common text here", 1) for w in "abcdefgh" * 10] + [(f"omega {w} common text here", 0) for w in "abcdefgh" * 10], epochs=200)
    import pyarrow as pa

    good, bad = words_only.evidence(pa.array(["common alpha text", "common omega text"]))
    assert good > 1 > -1 > bad


def test_site_rates_against_plain_python(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"h{int(x)}", f"p{int(y)}", float(e)) for i, (x, y, e) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.normal(0, 3, 300)))]
    scored = spark.createDataFrame([(i, (e, h, p)) for i, h, p, e in rows], "doc_id long, evidence struct<e: double, host: string, path: string>")
    prior = 0.7
    got = {r.doc_id: (r.site_log_odds, r.score) for r in quality.judge(scored, Workspace(spark, "t"), prior).collect()}
    own = {i: 1 / (1 + np.exp(-(e + np.log(prior / (1 - prior))))) for i, _, _, e in rows}
    group = lambda key: {k: [i for i, h, p, _ in rows if key(h, p) == k] for k in {key(h, p) for _, h, p, _ in rows}}
    hosts, paths = group(lambda h, p: h), group(lambda h, p: (h, p))

    def strength(groups, mu):
        n = np.array([len(x) for x in groups.values()], float)
        r = np.array([sum(own[i] for i in x) / len(x) for x in groups.values()])
        mean = np.array([mu(k) for k in groups])
        var = (mean * (1 - mean) * n).sum() / n.sum()
        between = ((n * (r - mean) ** 2).sum() - (len(n) - 1) * var) / (n.sum() - (n * n).sum() / n.sum())
        return min(max(var / between - 1 if between > 1e-9 else 1e4, 1.0), 1e4)

    mu = (sum(own.values()) + 1) / (len(rows) + 2)
    a = strength(hosts, lambda k: mu)
    b = strength(paths, lambda k: (sum(own[i] for i in hosts[k[0]]) + mu * a) / (len(hosts[k[0]]) + a))
    for i, h, p, e in rows:
        other_h, other_p = [j for j in hosts[h] if j != i], [j for j in paths[h, p] if j != i]
        host = (sum(own[j] for j in other_h) + mu * a) / (len(other_h) + a)
        rate = (sum(own[j] for j in other_p) + host * b) / (len(other_p) + b)
        site = np.clip(np.log(rate / (1 - rate)), -4, 4)
        assert abs(got[i][0] - site) < 1e-9 and abs(got[i][1] - 1 / (1 + np.exp(-(e + site)))) < 1e-9


def test_long_texts_are_taken_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(10)
    text = _prose(rng, ["th", "ing", "é", "ß", "日本"], 3000)
    array = pa.array([text])
    lang = language.train([(_prose(rng, ["th", "ing"], 30), "en") for _ in range(20)] + [(_prose(rng, ["ß", "é"], 30), "de") for _ in range(20)], epochs=2)
    tox = toxicity.train([("a fine day it is " + w, k) for k, w in enumerate(["today", "vermin"] * 20) for k in [k % 2]], turns=2, bits=12)
    whole = lang.probabilities(array)[0], tox.margins(array), quality.features(array)
    for module in (language, toxicity, quality):
        monkeypatch.setattr(module, "BLOCK_BYTES", 501)
    again = lang.probabilities(array)[0], tox.margins(array), quality.features(array)
    assert all(np.allclose(x, y) for x, y in zip(whole, again))
    import public_tokenizers as P

    codec = bpe.Codec(bpe.serialise(bpe.read_ranks(P.path(bpe.VOCABULARY))), P.PATTERN)
    text = "It's  fine, a b  c1 d 2 e\n f. " * 400 + text
    one = codec.encode([text])
    monkeypatch.setattr(bpe, "PIECE_CHARS", 97)
    assert codec.encode([text, "", "a b", text]) == [one[0], b"", *codec.encode(["a b"]), one[0]] and len(codec.pieces(text)) > 50


def test_samples_are_bounded_and_keep_a_rows_own_label(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, "en text", "en"), (1, "de text", "de"), (2, long, "en"), (2, long, "en"), (3, None, "en"), (4, "x", None)], "id long, text string, label string")
    got = sampling.sample_rows(df, 10, "s")
    assert {(t, k) for t, k in got if t != long} == {("en text", "en"), ("de text", "de")} and len(got) == 3
    assert [t for t, _ in got if t.startswith("w0")] == [long]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    assert sorted(k for _, k in sampling.labelled_sample(df.select("id", "text"), labels, 10, "s")) == [0, 1, 1]
    assert sampling.sample_rows(df.limit(0), 10, "s") == []


def test_samples_hold_whole_texts_within_their_bounds(spark, monkeypatch):
    texts = [(i, f"t{i} " * (1000 if i % 10 == 0 else 10), "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(texts, "id long, text string, label string")
    monkeypatch.setattr(sampling, "SAMPLE_CHARS", 100_000)
    monkeypatch.setattr(sampling, "LONGEST", 20_000)
    got = sampling.sample_rows(df, 500, "s")
    assert {t for t, _ in got} <= {t for _, t, _ in texts} and 40_000 < sum(len(t) for t, _ in got) < 200_000 and got == sampling.sample_rows(df, 500, "s")
    assert any(len(t) > 4000 for t, _ in got)  # long ones are drawn like others
    monkeypatch.setattr(sampling, "SAMPLE_ROWS", 1)
    with pytest.raises(ValueError, match="labels"):
        sampling.sample_rows(df, 500, "s")


def _mixed(h, n):
    return (((h + n) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF)


def plain_language(model, text):
    """Logits in plain Python: byte n-grams in a dict."""
    lower = "".join(c if ord(c) > 127 or (c.isascii() and c.isalpha()) else " " for c in f" {text.lower()} ").encode()
    bits = len(model.table).bit_length() - 1
    total, count, known = np.zeros(len(model.languages)), 0, {}
    for i in range(len(lower) - 1):
        h = lower[i]
        for n in (2, 3, 4):
            gram = lower[i : i + n]
            if len(gram) < n or gram[:2] == b"  ":
                break
            h = ((h * 0x01000193) & 0xFFFFFFFF) ^ gram[-1]
            known.setdefault(gram, model.table[_mixed(h, n) >> (32 - bits)])
            total, count = total + known[gram], count + 1
    z = (total / max(1, count) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def test_language_against_a_plain_scorer(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").where("lang is not null").collect()]
    model = language.train(rows, epochs=3)
    texts = [t for t, _ in rows[:60]] + ["", "a", "  ", "é", "ab", "Ünïcode ЖЗ 日本 x1y2", "A" * 3000]
    got, lettered = model.probabilities(pa.array(texts))
    assert np.allclose(got, [plain_language(model, t) for t in texts], atol=1e-5)
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def plain_toxicity(model, text):
    """The margin in plain Python, word by word and window by window."""
    fold = set(" .,;:!?()[]{}\"'`|<>/\\") | {chr(c) for c in range(33)}
    chars = "".join(" " if c in fold else c for c in f" {text.lower()} ")
    bits = len(model.weights).bit_length() - 1
    starts = [i for i, c in enumerate(chars) if c == " "]
    words = []
    for a, b in zip(starts, [*starts[1:], len(chars)]):
        found = []
        for i in range(a, b):
            for n in (3, 4, 5):
                gram = chars[i : i + n]
                if len(gram) < n or " " in gram[1:-1]:
                    break
                h = ord(gram[0])
                for c in gram[1:]:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ ord(c)
                found.append(float(model.weights[_mixed(h, n) >> (32 - bits)]))
        if found:
            words.append(sum(found) / len(found))
    spans = [words[k : k + toxicity.WINDOW] for k in range(max(1, len(words) - toxicity.WINDOW + 1))]
    return max((sum(w) / len(w) for w in spans if w), default=-np.inf) + model.bias


def test_toxicity_against_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.text, r.toxic) for r in docs.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("text", "toxic").collect()]
    model = toxicity.train(rows, turns=2)
    texts = [t for t, _ in rows[:40]] + ["", "a", " . ", "Ünïcode ЖЗ 日本語テキスト, (x)", "one two", "z" * 500]
    got = model.margins(pa.array(texts))
    assert np.allclose(got, [plain_toxicity(model, t) for t in texts], atol=1e-4)


def test_rejection_tells_texts_from_shuffled_letters():
    rng = np.random.default_rng(3)
    vocabulary = {k: ["".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(300)] for k, letters in (("x", "abcdefgh"), ("y", "ghijklmn"))}
    rows = [(" ".join(rng.choice(vocabulary[k], 60)), k) for k in "xy" for _ in range(200)]
    model = language.train(rows)
    assert model.lost <= 0.02 and 0 < model.threshold < 1
    text = "Ab, c1 é"
    assert sorted(language.shuffled(text, rng)) == sorted(text) and language.shuffled(text, rng)[2:4] == ", "
    assert language.bound(np.array([0.9, 0.95]), np.array([0.3, 0.5])) == (0.5 + 1e-9, 0.0, 0.0)
    assert language.bound(np.array([]), np.array([]))[1:] == (0.0, 1.0)


def test_mix_keeps_columns_of_any_name(spark, docs):
    from pyspark.sql import functions as F

    names = ["__size", "__own", "__in", "__u", "__id", "__pattern", "__source", "helper", "bound", "totals", "copy", "__copy"]
    df = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    plain = {(r.doc_id, r.text, r.source): r["__mix"] for r in mixing.mix(docs).collect()}
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "__mix"]
    for r in got.collect():
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names) and plain[r.doc_id, r.text, r.source] == r["__mix"]
    assert mixing.mixed_rows(df).columns == df.columns


def test_flow_of_overlapping_sources_against_brute_force(spark):
    capacity, quota = {("a", "b"): 2, ("b", "c"): 2, ("a",): 1, ("c",): 1}, {"a": 3, "b": 2, "c": 4}
    flow = mixing.route(capacity, quota)
    arcs = [(p, s) for p in capacity for s in p]

    def cost(f):
        out = 0
        for p, words in capacity.items():
            sent = sum(n for (q, _), n in f.items() if q == p)
            if sent > 2 * words:
                return None
            out += sent + 2 * max(0, sent - words)
        return out if all(sum(n for (_, t), n in f.items() if t == s) <= q for s, q in quota.items()) else None

    best = max((sum(v), -c) for v in itertools.product(range(5), repeat=len(arcs)) if (c := cost(dict(zip(arcs, v)))) is not None)
    mine = {(p, s): n for p, to in flow.items() for s, n in to.items()}
    assert (sum(mine.values()), -cost(mine)) == best


def test_mix_of_overlapping_sources(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9))), "a", [["a"], ["a", "b"], ["b", "c"], ["c"]][int(rng.integers(4))]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, sources array<string>")
    got = mixing.mix(df, sources_col="sources").collect()
    words = {i: len(t.split()) for i, t, *_ in rows}
    sizes = {s: sum(words[i] for i, _, _, m in rows if s in m) for s in "abc"}
    target = mixing.quotas(sizes)
    assert all(r["__mix"].taken in (0, words[r.doc_id], 2 * words[r.doc_id]) for r in got)
    capacity = collections.Counter()
    for i, _, _, m in rows:
        capacity[tuple(m)] += words[i]
    flow = mixing.route(dict(capacity), target)
    taken = collections.Counter()
    for r in got:
        taken[tuple(r.sources)] += r["__mix"].taken
    assert all(abs(taken[p] - sum(flow[p].values())) <= 10 for p in capacity)
    assert abs(sum(taken.values()) - min(sum(target.values()), 2 * sum(words.values()))) <= 40


def test_classifiers_are_trained_in_a_task(spark, monkeypatch):
    """The sample's texts don't reach the driver, and the model is the one that the driver would have trained, but for the order of sums."""
    rows = [(i, f"{'the fine day' if i % 2 else 'der gute Tag'} {i} {i * 7}", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = language.train(sampling.sample_rows(docs.selectExpr("doc_id as id", "text", "lang as label"), 20, "language"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    known = quality.train(sampling.labelled_sample(docs.selectExpr("doc_id as id", "text"), labels.selectExpr("doc_id as id", "quality as label"), 20, "quality"))
    seen, real = [], sampling._ordered
    monkeypatch.setattr(sampling, "_ordered", lambda found: seen.append(len(found)) or real(found))
    got = language.fit_language(docs, 20, learn="true")
    assert got.languages == want.languages and np.allclose(got.table, want.table, atol=1e-3)
    model, rate = quality.fit_quality(docs, labels, 20)
    assert np.allclose(model.hidden, known.hidden, atol=1e-3) and abs(model.bias - known.bias) < 1e-3 and rate == 31 / 62
    assert not seen  # in this process
    assert language.fit_language(docs.limit(0)).languages == ["und"]


def test_packing_writes_no_ids_where_the_total_is_known(spark, docs, monkeypatch):
    from gritmill.llm.common import Workspace, scratch

    cut, real = [], Workspace.cut
    monkeypatch.setattr(Workspace, "cut", lambda self, df, name="t", *a: cut.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(self, df, name, *a))
    root = scratch(spark, "packed")
    report = packing.pack(bpe.pack(docs.select("doc_id", "text")), root, dtype="<u2", length=128, pad=0xFFFF, total=1000)
    assert [name for name, _ in cut] == ["report"] and cut[0][1].count("ArrowEvalPython") == 1  # encoded once
    back = collections.defaultdict(dict)
    for r in packing.unpack(spark, root, report, dtype="<u2").collect():
        back[r.id][r.piece] = np.frombuffer(bytes(r.data), "<u2").astype("<u4")
    want = {r.doc_id: r.ids for r in bpe.encode(docs).collect() if r.ids}
    assert {i: np.concatenate([p[k] for k in sorted(p)]).tolist() for i, p in back.items()} == {i: list(x) for i, x in want.items()}


def test_bpe_by_bytes_equals_tiktoken_where_classes_meet(spark):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path(bpe.VOCABULARY))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(bpe.serialise(tokens), P.PATTERN)
    parts = ["'", " ", "\n", "\t", "a", "s", "t", "re", "ve", "ll", "m", "d", "l", "S", "1", "9", ".", "!", "_", "\x00", "é", "ȿ", "×", "÷", "ɏ", "ɐ", "\x1c", "\xa0", "日", "٣"]
    rng = np.random.default_rng(7)
    cases = ["".join(rng.choice(parts[: 22 if k % 2 else None], rng.integers(0, 12))) for k in range(6000)] + [f"{chr(i)} {chr(i)}a1{chr(i)}" for i in range(0x300)]
    for t, packed in zip(cases, codec.encode(cases)):
        assert np.frombuffer(packed, "<u4").tolist() == e.encode_ordinary(t), t
    part = pa.array(["xy", *cases], pa.string()).slice(5, 900)
    assert codec.encode(part) == codec.encode(part.to_pylist())
    with pytest.raises(pa.ArrowInvalid):
        codec.encode(pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], np.int32)), pa.py_buffer(b"a\x80")]))
    words = bpe.Codec(bpe.serialise(tokens), r"\w+")  # a pattern that leaves something out
    assert [words.decode(x) for x in words.encode(["a, b", "", "c d\n"])] == [b"ab", b"", b"cd"]


def test_bpe_looks_a_blocks_pre_tokens_up_once_each(spark):
    import public_tokenizers as P

    class Counted(dict):
        seen = 0

        def get(self, key, default=None):
            Counted.seen += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.seen += 1
            return super().__contains__(key)

    codec = bpe.Codec(bpe.serialise(bpe.read_ranks(P.path(bpe.VOCABULARY))), P.PATTERN)
    codec.known = Counted()
    got = codec.encode(["the cat sat\n"] * 500)
    assert Counted.seen <= 10 and set(map(codec.decode, got)) == {b"the cat sat\n"}
