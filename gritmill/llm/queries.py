"""The queries of the ten operators and their SQL; each runs over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, caps, chunking, language, minhash, mixing, negatives, packing, quality, toxicity, urls, warc
from .common import Workspace, crc_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = crc_of(F.col("id")) % 5 != 0
    model, prior = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), learn=held)
    ws = Workspace(spark, "quality")
    scored = ws.cut(quality.with_evidence(docs, model).select("doc_id", "evidence"), "scored")
    out = quality.judge(scored, ws, prior)
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "evidence", "site_log_odds", "score", "rejected")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.media_of(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs)
    m = F.col("__mix")
    return out.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), m["taken"].alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of op9, as unsigned 16-bit integers, packed into rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # a token of two bytes stands for four bytes of prose, and for one at least: groups may have half the usual size, or twice
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return packing.pack(bpe.pack(docs), dtype="<u2", pad=0xFFFF, total=total)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


#: The list that pages are judged by.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_minhash, op3_quality, op4_packing, op5_media, op6_language, op7_warc, op8_embedding, op9_bpe, op10_mixing,
        op11_negatives, op12_alignment, op13_urls, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.h = f.h
    """,
    "op8_embedding": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
        c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
        n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
               coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN c ON c.id = e.vec_id
    """,
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS u FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
        o AS (SELECT *, 1.5 * sum(source_size) OVER () AS total, 2.0 * source_size / w AS ratio FROM s),
        k AS (SELECT *, coalesce(sum(2.0 * source_size) OVER b, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left FROM o
              WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lv AS (SELECT arg_min((total - full_before) / w_left, ratio) AS level FROM k WHERE (total - full_before) / w_left <= ratio),
        t AS (SELECT source, source_size, least(2.0 * source_size, w * level) AS target FROM o, lv),
        p AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CAST(least(2, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 1 END) AS BIGINT) AS whole FROM t),
        r AS (SELECT d.*, p.source_size, p.target, p.whole, CASE WHEN p.source_size > 0 THEN p.words - p.whole * p.source_size ELSE 0 END AS more,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN more > 0 AND (upto <= more OR (upto - size <= more AND upto - more < more - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r
    """,
    "op11_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op13_urls": r"""
        WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
        h AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM u),
        r(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        f AS (SELECT h.page_id, rule_host || rule_path AS rule, verdict FROM h JOIN r
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
        b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id)
        SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN b ON h.page_id = b.page_id
    """,
}
