"""Document quality by the votes of the nearest labelled documents.

A text becomes weighted counts of terms (shapes of three characters, hashed words,
repetitions), a truncated singular value decomposition of a bounded labelled sample
maps them to a latent semantic space, and every document meets every labelled vector
there in blocked exact cosine products.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_sample, in_batches, send
from leaguelens.session import checkpointed

# Classes of characters besides letters, digits and white space. Fixed values.
MARKS = [".", ",;:", "!?", "'\"-", "|", "#*_~=`", "$%&@^+", "()[]{}<>/\\"]
CLASSES = 16
SHAPES = CLASSES**3
WORDS = 2048
REPEATS = 4
TERMS = SHAPES + WORDS + REPEATS
CHARS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 256

# What the fit is bounded by, whatever the size of the corpus.
SAMPLE_ROWS = 3000
LATENT = 64
NEIGHBOURS = 15
POWER = 4


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, CLASSES - 1, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = 0 if c.islower() else 1 if c.isupper() else 2
        elif c.isdecimal():
            out[code] = 3
        elif c.isspace():
            out[code] = 4 if c == " " else 5 if c == "\n" else 6
    for k, marks in enumerate(MARKS):
        out[[ord(c) for c in marks]] = 7 + k
    return out


def term_counts(text: str) -> np.ndarray:
    """Counts of the terms of a whole text."""
    out = np.zeros(TERMS, np.float32)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for at in range(0, len(codes), CHARS_AT_ONCE):
        one = classes()[codes[at : at + CHARS_AT_ONCE + 2]].astype(np.int32)
        if len(one) > 2:
            shape = (one[:-2] * CLASSES + one[1:-1]) * CLASSES + one[2:]
            out[:SHAPES] += np.bincount(shape, minlength=SHAPES)
    words = text.lower().encode().split()
    if words:
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        out[SHAPES : SHAPES + WORDS] = np.bincount(hashes % WORDS, minlength=WORDS)
        for far in range(1, REPEATS + 1):
            out[SHAPES + WORDS + far - 1] = np.count_nonzero(hashes[far:] == hashes[:-far])
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled documents x latent dimensions, length 1
    labels: np.ndarray


def latent(counts: np.ndarray, weight: np.ndarray, axes: np.ndarray) -> np.ndarray:
    terms = np.log1p(counts) * weight
    out = terms @ axes
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 0, out / np.where(size > 0, size, 1), 0).astype(np.float32)


def _axes(terms: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *terms.shape)
    basis = np.random.default_rng(7).standard_normal((terms.shape[1], min(rank + 16, *terms.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(terms.T @ (terms @ basis))
    _, _, turn = np.linalg.svd(terms @ basis, full_matrices=False)
    return (basis @ turn.T[:, :rank]).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS, rank: int = LATENT,
) -> Model | None:
    """Fit on at most about 1.2 ``sample_rows`` labelled rows, equally many of both labels if there are enough.

    ``learn`` is a condition on the key. Repeated keys count once, with their
    least label and text; null labels and texts are left out. None if nothing is left.
    """
    marked = (
        labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    )
    counts = marked.groupBy("label").count()
    chosen = checkpointed(bounded_sample(marked, F.col("key"), sample_rows, counts, "label"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    # the sample is bounded by its parameter, so its side may be sent to every task
    rows = rows.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def make():
        def step(batch):
            place, count = [], []
            for t in batch.column(0).to_pylist():
                terms = term_counts(t)
                used = np.flatnonzero(terms)
                place.append(used.astype(np.int32).tobytes())
                count.append(terms[used].tobytes())
            arrays = [batch.column(1), pa.array(place, pa.binary()), pa.array(count, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["label", "place", "count"])

        return step

    found = in_batches(rows.select("text", "label"), make, "label int, place binary, count binary")
    found = found.orderBy("label", "place", "count").collect()
    if not found:
        return None
    counts = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        counts[k, np.frombuffer(r["place"], np.int32)] = np.frombuffer(r["count"], np.float32)
    weight = np.log((1 + len(found)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32)
    np.log1p(counts, out=counts)
    counts *= weight
    size = np.linalg.norm(counts, axis=1, keepdims=True)
    counts /= np.where(size > 0, size, 1)
    axes = _axes(counts, rank)
    vectors = counts @ axes
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(size > 0, vectors / np.where(size > 0, size, 1), 0).astype(np.float32)
    return Model(weight, axes, vectors, np.array([r["label"] for r in found], np.float32))


def vote(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of the nearest labelled vectors, weighted by a power of their cosine."""
    cosine = vectors @ model.vectors.T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(cosine, near, 1), 0, None).astype(np.float64) ** POWER
    total = weight.sum(1)
    prior = float(model.labels.mean())
    return np.where(total > 0, (weight * model.labels[near]).sum(1) / np.where(total > 0, total, 1), prior)


def score(
    docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", out: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``keep`` columns of every row with score (0 to 1) and predicted (1 from 0.5 on), named as in ``out``.

    Null and empty texts, which no term describes, score the share of label 1 in
    the sample; without any labelled document every score is 0.5.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = send(docs.sparkSession, model)

    def make():
        fitted = sent.value

        def step(batch):
            texts = batch.column(len(keep)).to_pylist()
            value = np.full(len(texts), 0.5)
            for at in range(0, len(texts), ROWS_AT_ONCE) if fitted else ():
                counts = np.array([term_counts(t or "") for t in texts[at : at + ROWS_AT_ONCE]])
                value[at : at + len(counts)] = np.clip(vote(fitted, latent(counts, fitted.weight, fitted.axes)), 0, 1)
            arrays = [*batch.columns[: len(keep)], pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=[*keep, *out])

        return step

    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out[0]}` double", f"`{out[1]}` int"])
    return in_batches(narrow, make, schema)
