from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from leaguelens.llm import langid, quality
from tests.llm.frames import SMALL, documents, labels
from tests.llm.test_near_copies import _kept
from tests.llm.test_tokens import _check_packed


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        folder = f"file://{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out[name] = docs
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in list(out)[:-1]:
        assert out[name].columns == first.columns
    assert out["language_id"].count() == first.count()  # all are prose with a language
    marks = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r["doc_id"]: r["text"] for r in out["quality_classifier"].collect()}
    gone = {r["doc_id"] for r in first.collect()} - set(kept)
    assert all(marks.get(k) != 1 for k in gone) and all(marks.get(k) != 0 for k in kept)
    ids = sorted(kept)
    want = {ids[k] for k in _kept([(k, kept[k]) for k in ids])}
    rows = out["simhash_near_dedup"].collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    words = {r["doc_id"]: len(r["text"].split()) for r in rows}
    _check_packed(out["packing"].collect(), words, 2048, 65_536)
    assert sorted(map(repr, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(repr, out["packing"].collect()))


def test_stages_stand_odd_rows(spark, tmp_path):
    labels(spark).write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = documents(spark)
    before = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, f"file://{tmp_path}")
    assert kept.columns == before
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 9} and not {r["doc_id"] for r in kept.collect()} & {2, 3, 6, 7}
    judged = corpus_pipeline.quality_filter(spark, docs, f"file://{tmp_path}")
    assert judged.columns == before
    single = corpus_pipeline.near_dedup(spark, docs, f"file://{tmp_path}")
    assert single.columns == before and single.where("doc_id in (1, 4)").count() == 1
    assert corpus_pipeline.pack(spark, docs, f"file://{tmp_path}").count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def test_a_hot_key_does_not_swell_the_samples(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"),
        F.lit(1).alias("quality"),
    )
    model = langid.fit(rows, F.lit(True), sample_rows=10_000)
    assert model.languages == ["en"]
    marked = quality.fit(rows, rows.select("doc_id", "quality"), F.lit(True), sample_rows=10_000)
    assert len(marked.labels) == 1001
