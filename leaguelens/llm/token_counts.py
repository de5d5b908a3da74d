"""Token counts from a cache keyed by digests.

The cache is a Parquet table of content digest and count, in one folder for each
version of a tokenizer (the digest of its file). A run joins the documents' digests
to it, encodes one text of each digest that it lacks, and appends these counts.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from leaguelens.llm.bpe import BLANK, ENDINGS, byte_level
from leaguelens.llm.common import in_batches
from leaguelens.session import checkpointed

LIMIT = 1024
MEMO = 300_000
CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

# White space beside white space: there the tokenizer's pieces may cross a blank or a line break.
CROSSED = re.compile(r"\s\s")


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts a byte-level tokenizer's tokens.

    Its pieces never cross the border before a blank, or either border of a line break,
    that stands between two other characters, so line breaks and words, each with its
    blank, count by themselves. The library counts each distinct word once; texts with
    other runs of white space it counts whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.line_break = self._lengths(["\n"])[0]
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, memo: dict[str, int], words: set[str], before: str) -> None:
        other = []
        for word in words - memo.keys():
            body, mark = (word[:-1], 1) if word[-1:] and word[-1] in ENDINGS else (word, 0)
            # letters below U+0100 are one piece, which the library's model takes as it is; an ending is one token
            if body.isalpha() and (body.isascii() or max(body) < "\u0100"):
                memo[word] = len(self.model.tokenize((BLANK if before else "") + byte_level(body))) + mark
            else:
                other.append(word)
        memo.update(zip(other, self._lengths([before + w for w in other]), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole = [k for k, t in enumerate(texts) if CROSSED.search(t)]
        for k, n in zip(whole, self._lengths([texts[k] for k in whole]), strict=True):
            out[k] = n
        skip = set(whole)
        lines = {k: [x.split(" ") for x in t.split("\n")] for k, t in enumerate(texts) if k not in skip}
        if len(self.first) + len(self.later) > MEMO:
            self.first, self.later = {}, {}
        self._learn(self.first, {w[0] for text in lines.values() for w in text}, "")
        self._learn(self.later, set(chain.from_iterable(w[1:] for text in lines.values() for w in text)), " ")
        first, later = self.first.__getitem__, self.later.__getitem__
        for k, text in lines.items():
            breaks = (len(text) - 1) * self.line_break
            out[k] = breaks + sum(first(w[0]) + sum(map(later, w[1:])) for w in text)
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _encode(misses: DataFrame, path: str) -> DataFrame:
    def make():
        tally = counter(path)

        def step(batch):
            found = tally.counts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

        return step

    return in_batches(misses, make, "digest binary, n_tokens long")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def count_tokens(
    docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder that all executors reach; it is made if absent, and grows by
    the contents not seen before. The content that the digest stands for is the whole
    text as the tokenizer gets it, in UTF-8; a null text is empty. Runs that append at
    the same time may store a digest twice, which does no harm. Repeated rows stay
    repeated, and an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    rows = checkpointed(docs.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest")))
    folder = f"{cache}/tokenizer={tokenizer_version(path)}"
    texts = docs.select(digest.alias("digest"), content.alias("text"))
    if _exists(spark, folder):
        stored = spark.read.schema(CACHE).parquet(folder)
        texts = texts.join(stored, "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    _encode(misses, path).write.mode("append").parquet(folder)
    stored = spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # cut here, so that the join below is a join of two plain inputs, whose hot keys Spark splits
    stored = checkpointed(stored)
    return rows.join(stored, "digest").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
