import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.llm import langid, quality
from leaguelens.llm.queries import QUERIES
from tests.llm.frames import SMALL, documents, labels


def _grams(text):
    s = text.lower()
    known = [c if c.isalpha() else " " for c in s]
    return {"".join(known[i : i + n]) for n in (1, 2, 3) for i in range(len(known) - n + 1)}


def test_kernel_is_the_share_of_common_grams():
    marks = ["the cat sat", "on a mat"]
    frequent = [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]
    symbols, seen = langid.symbol_table(frequent), np.zeros(langid.SPECTRUM, bool)
    rows = []
    for m in marks:
        langid.mark_grams(m, symbols, seen)
        rows.append(seen.copy())
    grams = np.flatnonzero(np.any(rows, axis=0)).astype(np.int32)
    scaled = np.array([r[grams] / np.sqrt(r.sum()) for r in rows]).T
    texts = ["the mat, the cat!", "zzz", "a", "on a mat"]
    got = langid.Scorer(frequent, grams, scaled).kernels(texts)
    for k, t in enumerate(texts):
        for m, mark in enumerate(marks):
            a, b = _grams(t), _grams(mark)
            assert got[k, m] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), abs=1e-6)


def test_grams_of_a_long_text_are_read_whole(monkeypatch):
    symbols = langid.symbol_table([ord("a"), ord("b")])
    whole, parts = np.zeros(langid.SPECTRUM, bool), np.zeros(langid.SPECTRUM, bool)
    text = "ab aab bba c" * 9
    langid.mark_grams(text, symbols, whole)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 5)
    langid.mark_grams(text, symbols, parts)
    assert (whole == parts).all()


def test_language_of_held_out_documents(spark):
    found = QUERIES["op1_language_id"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert found.count() == docs.count()


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    model = langid.fit(docs, F.lit(True))
    rows = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (1, 4, 9):
            assert r["lang_pred"] == "en"
    empty = docs.limit(0)
    assert langid.fit(empty, F.lit(True)) is None
    assert langid.predict(empty, None, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None, ["doc_id"]).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = rows.where("held_out and quality is not null").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95


def test_votes_equal_a_plain_search():
    rng = np.random.default_rng(5)
    known = rng.standard_normal((200, 8))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    marks = rng.integers(0, 2, 200).astype(np.float32)
    model = quality.Model(None, None, known, marks)
    asked = rng.standard_normal((30, 8))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    got = quality.vote(model, asked)
    for k, x in enumerate(asked):
        near = sorted(range(200), key=lambda m: -(known[m] @ x))[: quality.NEIGHBOURS]
        weight = [max(0, known[m] @ x) ** quality.POWER for m in near]
        assert got[k] == pytest.approx(sum(w * marks[m] for w, m in zip(weight, near, strict=True)) / sum(weight))
    assert quality.vote(model, np.zeros((1, 8)))[0] == pytest.approx(marks.mean())


def test_terms_of_a_long_text_are_read_whole(monkeypatch):
    text = "Word, word!! 12\nnext " * 7
    whole = quality.term_counts(text)
    monkeypatch.setattr(quality, "CHARS_AT_ONCE", 6)
    assert (quality.term_counts(text) == whole).all()
    assert not quality.term_counts("").any()


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    model = quality.fit(docs, labels(spark), F.lit(True))
    assert sorted(model.labels.tolist()) == [0, 0, 1, 1]
    rows = quality.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3)} == {0.5}
    assert quality.fit(docs, labels(spark).limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.score(docs, None, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0
