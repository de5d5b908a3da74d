import hashlib
import itertools
import json
import random
import re
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaguelens.llm import bpe, packing, token_counts
from leaguelens.llm.queries import QUERIES
from tests.llm.frames import SMALL, documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = (
    "aAbBeE1 \n\t\r'st  é É Σσς İıÅ가한م́̈ﬁ½Ⅷ\x1c\x1d\x85\xa0 　"
    "\U0001f600‍#$%_\x00​﻿日  the"
)
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't WE'LL 's", "'re.", "aaaaaaaaa", "abababab", ".,", "x."]


def fuzz(seed, n=1500):
    rng = random.Random(seed)
    out = ["", " ", "  ", " a ", "a  b", "\n a", "a \n", "a\nb", "\n\n", "a" * 3000 + " " + "ab" * 2000]
    for _ in range(n):
        parts = [rng.choice(ALPHABET) if rng.random() < 0.93 else rng.choice(SPECIAL) for _ in range(rng.randint(0, 40))]
        out.append("".join(parts))
    return [*out, *("".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 60))) for _ in range(n))]


def test_bpe_equals_the_library():
    coder, library = bpe.Codec(WORDS), Tokenizer.from_file(WORDS)
    texts = fuzz(1)
    part = bpe.Part(coder)
    part.add(pa.array(range(len(texts))), texts)
    for text, (ids, said) in zip(texts, part.encoded(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert said == library.decode(want, skip_special_tokens=False)


def test_merges_that_make_pairs_of_lower_rank(tmp_path):
    """Two ways to one token: the second makes a pair that ranks before it."""
    symbols = "abcd"
    merges = [("a", "b"), ("abc", "d"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("d", "a"), ("abc", "abc"), ("d", "abcabc")]
    vocab = {}
    for token in [*symbols, *(a + b for a, b in merges)]:
        vocab.setdefault(token, len(vocab))
    model = {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}
    ranked = bpe.Merges(model)
    assert ranked.careful.any()
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": model}))
    library = Tokenizer.from_file(str(path))
    words = ["".join(w) for n in range(1, 7) for w in itertools.product(symbols, repeat=n)]
    ids, size = bpe.encode_words(words, ranked)
    at = 0
    for word, n in zip(words, size.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(word).ids, word
        at += n


def test_bpe_query_and_odd_rows(spark, monkeypatch):
    library = Tokenizer.from_file(WORDS)

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = QUERIES["op5_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(texts[r["doc_id"]]) for r in rows)
    odd = documents(spark)
    got = sorted(map(repr, (tuple(r) for r in bpe.digests(odd, WORDS).collect())))
    assert got == sorted(repr((r["doc_id"], *want(r["text"]))) for r in odd.collect())
    assert bpe.digests(odd.limit(0), WORDS).count() == 0
    back = bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()
    said = {r["doc_id"]: r["text"] for r in back}
    assert said[1].startswith("the</w> cat</w>") and said[2] == ""


def test_counts_equal_the_library():
    tally, library = token_counts.Counter(BYTES), Tokenizer.from_file(BYTES)
    texts = fuzz(2)
    assert tally.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_query_encodes_only_what_the_cache_lacks(spark, tmp_path):
    library = Tokenizer.from_file(BYTES)
    docs = documents(spark)
    want = sorted(
        repr((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024))
        for r in docs.collect()
    )
    cache = f"file://{tmp_path}/cache"
    count = lambda df: sorted(repr(tuple(r)) for r in token_counts.count_tokens(df, BYTES, cache).collect())
    stored = lambda: spark.read.parquet(cache).count()
    assert len(count(docs.where("doc_id = 1"))) == 1 and stored() == 1
    assert count(docs) == want
    assert stored() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    before = stored()
    assert count(docs) == want and stored() == before
    # a wrong stored count shows that the cache is what is read
    version = token_counts.tokenizer_version(BYTES)
    empty = hashlib.sha256(b"other").digest()
    spark.createDataFrame([(empty, 77)], token_counts.CACHE).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    other = spark.createDataFrame([(1, "other")], "doc_id long, text string")
    assert token_counts.count_tokens(other, BYTES, cache).first()["n_tokens"] == 77
    assert token_counts.count_tokens(docs.limit(0), BYTES, cache).count() == 0
    assert token_counts.count_tokens(docs.limit(0), BYTES, f"file://{tmp_path}/new").count() == 0


def _least_padding(lengths, counts, buckets):
    best = None
    for ends in itertools.combinations(lengths[:-1], min(buckets, len(lengths)) - 1):
        ends = [*ends, lengths[-1]]
        cost = sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_buckets_have_the_least_padding(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 11)))
    counts = [rng.randint(1, 50) for _ in lengths]
    buckets = rng.randint(1, 5)
    ends = packing.best_buckets(lengths, counts, buckets)
    cost = sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
    assert len(ends) <= buckets and cost == _least_padding(lengths, counts, buckets)
    assert packing.best_buckets([], [], 3) == []


def _check_packed(rows, words, longest, budget):
    """Every token is in one sequence, and batches keep to the budget and are full but for the last."""
    total, batches = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert 0 <= r["n_tokens"] <= r["bucket_len"] <= longest and r["padding"] == r["bucket_len"] - r["n_tokens"]
        assert r["start"] == r["piece"] * longest
        batches.setdefault(r["bucket_len"], {}).setdefault(r["batch"], []).append(r["row_in_batch"])
    assert total == words
    for length, found in batches.items():
        most = max(1, budget // max(1, length))
        assert sorted(found) == list(range(len(found)))
        for k, places in found.items():
            assert sorted(places) == list(range(len(places)))
            assert len(places) == most or k == len(found) - 1 and len(places) <= most


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = QUERIES["op3_packing"](spark, SMALL).collect()
    _check_packed(rows, {r["doc_id"]: len(r["text"].split()) for r in docs}, packing.LONGEST, packing.BUDGET)
    lengths = [r["n_tokens"] for r in rows]
    ends = packing.best_buckets(sorted(set(lengths)), [lengths.count(x) for x in sorted(set(lengths))], packing.BUCKETS)
    assert {r["bucket_len"] for r in rows} == set(ends)


def test_packing_of_odd_rows(spark):
    docs = documents(spark)
    rows = packing.pack(docs, longest=64, buckets=3, budget=200).collect()
    words = {}
    for r in docs.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^ \t\n]+", r["text"] or ""))
    _check_packed(rows, words, 64, 200)
    assert packing.pack(docs.limit(0)).count() == 0
    given = packing.pack(docs, tokens=F.lit(5).cast("long"), longest=2, buckets=2, budget=1).collect()
    assert len(given) == 3 * len(docs.collect()) and {r["batch"] for r in given} != {0}
