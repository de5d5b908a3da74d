"""From raw documents to packed training batches, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.llm import langid, near_copies, packing, quality
from leaguelens.llm.common import prepare, table
from leaguelens.session import shared_folder

LANGUAGE_SCORE = 0.2  # a text that resembles every learnt language less than this is rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language.

    Learns from all rows that have a language. Null texts, texts without a letter and
    texts below ``LANGUAGE_SCORE`` go, unless no language could be learnt; the others
    stay as they are, columns included.
    """
    prepare(spark)
    model = langid.fit(docs, F.lit(True))
    scored = langid.predict(docs, model, docs.columns, out=("__lang", "__score"))
    known = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LANGUAGE_SCORE)
    return scored.where(known if model else F.col("text").rlike(r"\p{L}")).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose nearest labelled documents are mostly of low quality.

    Learns from the labels of the documents it is given; without any, all stay.
    """
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = quality.score(docs, model, docs.columns, out=("__score", "__good"))
    return scored.where("__good = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more of their shingles of five words.
    """
    prepare(spark)
    return near_copies.one_of_each(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's sequences with their bucket, batch and place; see ``packing.pack``."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("packing", pack),
]

# Kernel regression, nearest-neighbour votes and the search for near copies have no SQL counterpart;
# tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
