"""The corpus pipeline: language ID, quality, near-dedup, mixing and encoding, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor's table and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritmill.llm import bpe, language, minhash, mixing, quality
from gritmill.llm.common import Workspace, free_name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with calibrated confidence; the others go."""
    marked = tuple(free_name(docs, name) for name in ("lang_pred", "lang_score", "lang_rejected"))
    out = language.identify(docs, language.fit_language(docs), columns=marked)
    return out.where(~out[marked[2]]).drop(*marked)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is not below the rejection bound."""
    model, prior = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: free_name(docs, f"{c}_own") for c in docs.columns if c.lower() in quality.RESULTS}  # the classifier would replace them
    kept = quality.classify(docs.withColumnsRenamed(own), model, prior).where("not rejected")
    return kept.select(*[kept[f"`{own.get(c, c)}`"].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token ids, their number, and digests of the ids and of the decoded bytes, a row per row."""
    return bpe.digest(docs, ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]

#: Trained models and sketches take part, so the rows are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    ws, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, ws.cut(stage(spark, docs, sf_dir), f"stage-{k}")
        ws.drop(last)
    return docs
