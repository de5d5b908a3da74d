"""Packing by length buckets of least padding.

Documents are cut into sequences of at most ``longest`` tokens. The global histogram of
sequence lengths has at most that many entries; dynamic programming over it finds the
bucket lengths for which padding every sequence to its bucket's length costs least.
Inside a bucket, batches hold as many sequences as a budget of padded tokens allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import gapless
from leaguelens.session import checkpointed

LONGEST = 2048
BUCKETS = 16
BUDGET = 65_536


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` bucket lengths that minimise the padding of all sequences, ascending.

    ``cost[j]`` is the least padding of the lengths up to the j-th with one more bucket,
    whose length is the j-th: what went before, plus its length times the sequences since,
    less their tokens.
    """
    order = np.argsort(lengths)
    length, count = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    if not len(length):
        return []
    rows = np.r_[0, np.cumsum(count)]
    tokens = np.r_[0, np.cumsum(count * length)]
    n = len(length)
    far = np.iinfo(np.int64).max // 4
    cost = np.r_[0, np.full(n, far)]
    came = []
    for _ in range(min(buckets, n)):
        # from[i, j]: i lengths in earlier buckets, a new bucket for lengths i to j
        new, back = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + length[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            back[j] = total.argmin()
            new[j] = total[back[j]]
        new[0] = far
        came.append((new, back))
        cost = new
    k = int(np.argmin([new[n] for new, _ in came]))
    ends, j = [], n
    while k >= 0:
        ends.append(int(length[j - 1]))
        j, k = int(came[k][1][j]), k - 1
    return sorted(ends)


def word_count(text: Column) -> Column:
    """Tokens of a text if nothing else is given: its words between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def pack(
    docs: DataFrame, key: str = "doc_id", tokens: Column | None = None, longest: int = LONGEST,
    buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """One row per sequence: key, piece, start, n_tokens, bucket_len, batch, row_in_batch, padding.

    ``tokens`` counts a document's tokens, by default the words of ``text``. A document
    longer than ``longest`` gives several sequences, ``piece`` by ``piece`` from token
    ``start`` on, so no token is lost; a null text or one without a word gives one
    sequence of length 0. Batches are numbered from 0 in each bucket, and all but a
    bucket's last are full: as many rows as ``budget`` allows at the bucket's length, one
    at least. Rows are dealt to batches by hash. Repeated rows are packed each. Other
    columns are ignored; an empty table gives an empty result.
    """
    counted = docs.select(F.col(key).alias("key"), (word_count(F.col("text")) if tokens is None else tokens).alias("total"))
    parts = F.greatest(F.ceil(F.col("total") / longest), F.lit(1)).cast("int")
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), parts - 1)))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select("key", "piece", start.alias("start"), F.least("total", start + longest).alias("upto"))
    pieces = checkpointed(pieces.select("key", "piece", "start", (F.col("upto") - F.col("start")).alias("n_tokens")))
    # at most one entry for each length up to the longest
    histogram = pieces.groupBy("n_tokens").count().collect()
    ends = best_buckets([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<bigint>")
    bucket = F.array_min(F.filter(bounds, lambda e: e >= F.col("n_tokens")))
    numbered = gapless(pieces.withColumn("bucket_len", bucket), "bucket_len", ["key", "piece", "n_tokens"], "place")
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1)).cast("long")
    return numbered.select(
        F.col("key").alias(key), "piece", "start", "n_tokens", "bucket_len",
        F.floor(F.col("place") / rows).cast("long").alias("batch"),
        F.pmod("place", rows).cast("int").alias("row_in_batch"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
