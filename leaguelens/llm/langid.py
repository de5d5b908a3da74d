"""Language identification with string kernels.

Two texts are as similar as the share of letter n-grams (one to three letters,
counted once each) that both contain: a blended-spectrum presence kernel. Landmark
texts span a Nyström approximation of it, on which one ridge regression per
language is fitted. A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_sample, in_batches, send, spread_hash
from leaguelens.session import checkpointed

UNKNOWN = "und"
SYMBOLS = 64  # 0: no letter; 1 to 62: the most frequent letters; 63: any other letter
SPECTRUM = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
CHARS_AT_ONCE = 1 << 20
CELLS_AT_ONCE = 1 << 21

# What the fit is bounded by, whatever the size of the corpus.
SAMPLE_ROWS = 3000
LANDMARKS = 128
LANGUAGES = 256
RIDGE = 1e-2


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def symbol_table(frequent: list[int]) -> np.ndarray:
    out = np.where(letters(), SYMBOLS - 1, 0).astype(np.uint8)
    for k, code in enumerate(frequent[: SYMBOLS - 2]):
        out[code] = k + 1
    return out


def mark_grams(text: str, symbols: np.ndarray, seen: np.ndarray) -> None:
    """Set ``seen`` to the n-grams that the whole text contains."""
    seen[:] = False
    codes = _codes(text)
    for at in range(0, len(codes), CHARS_AT_ONCE):
        one = symbols[codes[at : at + CHARS_AT_ONCE + 2]].astype(np.int32)
        seen[one] = True
        if len(one) > 1:
            two = one[:-1] * SYMBOLS + one[1:]
            seen[two + SYMBOLS] = True
        if len(one) > 2:
            seen[two[:-1] * SYMBOLS + one[2:] + SYMBOLS + SYMBOLS**2] = True


@dataclass
class Model:
    languages: list[str]
    frequent: list[int]  # letters with a symbol of their own
    grams: np.ndarray  # n-grams of any landmark
    landmarks: np.ndarray  # grams x landmarks, 1 where contained, scaled by the landmark's norm
    weights: np.ndarray  # landmarks x languages
    offset: np.ndarray  # by language


class Scorer:
    """Kernel values of texts against the landmarks, and scores by language."""

    def __init__(self, frequent, grams, landmarks):
        self.symbols = symbol_table(frequent)
        self.grams, self.landmarks = grams, landmarks.astype(np.float32)
        self.seen = np.zeros(SPECTRUM, bool)
        self.rows = max(1, min(256, CELLS_AT_ONCE // max(1, len(grams))))

    def kernels(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        block = np.zeros((self.rows, len(self.grams)), np.float32)
        for at in range(0, len(texts), self.rows):
            part = texts[at : at + self.rows]
            for k, text in enumerate(part):
                mark_grams(text, self.symbols, self.seen)
                size = np.count_nonzero(self.seen)
                block[k] = self.seen[self.grams]
                block[k] *= 1 / np.sqrt(max(size, 1))
            out[at : at + len(part)] = block[: len(part)] @ self.landmarks
        return out


def _letter_counts(sample: DataFrame) -> list[int]:
    def make():
        def step(batch):
            total = np.zeros(0x110000, np.int64)
            for text in batch.column(0).to_pylist():
                codes = _codes(text)
                for at in range(0, len(codes), CHARS_AT_ONCE):
                    part = np.bincount(codes[at : at + CHARS_AT_ONCE])
                    total[: len(part)] += part
            used = np.flatnonzero((total > 0) & letters())
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

        return step

    counts = in_batches(sample.select("text"), make, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return [r["code"] for r in counts.orderBy(F.desc("n"), "code").limit(SYMBOLS - 2).collect()]


def _landmark_grams(sample: DataFrame, frequent: list[int], landmarks: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of any landmark, and which landmark has which, scaled."""
    share = max(1, landmarks // max(1, sample.select("lang").distinct().count()))

    def make():
        symbols, seen = symbol_table(frequent), np.zeros(SPECTRUM, bool)

        def step(batch):
            out = []
            for text in batch.column(0).to_pylist():
                mark_grams(text, symbols, seen)
                out.append(np.packbits(seen).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["grams"])

        return step

    rank = F.row_number().over(W.partitionBy("lang").orderBy(spread_hash(F.lit("landmark"), F.col("text")), "text"))
    chosen = sample.select("lang", "text").distinct().withColumn("rank", rank).where(F.col("rank") <= share)
    chosen = chosen.orderBy("rank", "lang").limit(landmarks).select("text")
    rows = [r["grams"] for r in in_batches(chosen, make, "grams binary").collect()]
    used = np.zeros(SPECTRUM, bool)
    for row in rows:
        used |= np.unpackbits(np.frombuffer(row, np.uint8))[:SPECTRUM].astype(bool)
    grams = np.flatnonzero(used).astype(np.int32)
    seen = np.zeros((len(grams), len(rows)), np.float32)
    for k, row in enumerate(sorted(rows)):
        has = np.unpackbits(np.frombuffer(row, np.uint8))[:SPECTRUM].astype(bool)
        seen[:, k] = has[grams] / np.sqrt(max(1, np.count_nonzero(has)))
    return grams, seen


def fit(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE,
) -> Model | None:
    """Fit on at most about 1.2 ``sample_rows`` of the rows where ``learn`` holds.

    Rows without text, letters or language are not learnt from; of rows with the
    same key one is. None if no row is left.
    """
    spark = docs.sparkSession
    rows = docs.where(learn).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = docs.where(learn & F.col(key).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sample = bounded_sample(rows, F.col("key"), sample_rows, counts, "lang")
    sample = sample.groupBy("key").agg(F.min(F.struct("text", "lang")).alias("x"))
    sample = checkpointed(sample.select("key", "x.text", "x.lang"))
    if sample.isEmpty():
        return None
    frequent = _letter_counts(sample)
    grams, marks = _landmark_grams(sample, frequent, landmarks)
    sent = send(spark, (frequent, grams, marks))

    def make():
        scorer = Scorer(*sent.value)

        def step(batch):
            kernels = [k.tobytes() for k in scorer.kernels(batch.column(0).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(kernels, pa.binary())], names=["lang", "k"])

        return step

    found = in_batches(sample.select("text", "lang"), make, "lang string, k binary").orderBy("lang", "k").collect()
    kernels = np.array([np.frombuffer(r["k"], np.float32) for r in found], np.float64)
    languages = sorted({r["lang"] for r in found})
    place = {x: k for k, x in enumerate(languages)}
    target = np.zeros((len(found), len(languages)))
    target[np.arange(len(found)), [place[r["lang"]] for r in found]] = 1
    values, vectors = np.linalg.eigh(marks.T.astype(np.float64) @ marks)
    large = values > 1e-6 * values.max()
    whiten = vectors[:, large] / np.sqrt(values[large])
    phi = kernels @ whiten
    mean, base = phi.mean(0), target.mean(0)
    phi -= mean
    solved = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ (target - base))
    return Model(languages, frequent, grams, marks, whiten @ solved, base - mean @ solved)


def predict(
    docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score, named as in ``out``.

    ``lang_pred`` is the language with the highest regression value, the first by
    name among equals, and ``score`` that value cut to 0..1. A text that is null
    or has no letter, and any text if nothing could be learnt, is ``und`` with
    score 0. Every text is read whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = send(docs.sparkSession, model)
    out_names = list(out)

    def make():
        fitted = sent.value
        scorer = Scorer(fitted.frequent, fitted.grams, fitted.landmarks) if fitted else None
        is_letter = letters()

        def step(batch):
            texts = batch.column(len(keep)).to_pylist()
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            rows = [k for k, t in enumerate(texts) if t and is_letter[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()]
            if rows and fitted:
                value = scorer.kernels([texts[k] for k in rows]) @ fitted.weights + fitted.offset
                best = value.argmax(1)
                lang[rows] = np.array(fitted.languages, object)[best]
                score[rows] = np.clip(value[np.arange(len(rows)), best], 0, 1)
            return pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)],
                names=[*keep, *out_names],
            )

        return step

    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out[0]}` string", f"`{out[1]}` double"])
    return in_batches(narrow, make, schema)
