import base64
import gzip
import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.llm import fingerprints, sharding, warc
from leaguelens.llm.queries import ORACLE, QUERIES
from tests.llm.frames import SMALL, documents
from tests.oracle import compare, connect


def test_shards_are_numbered_and_grow_into_the_new_one(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plan = QUERIES["op6_sharding"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shares_follow_weights_and_movement_keeps_to_the_path(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "key")
    found = keys
    for n in (24, 25, 26, 29, 37):
        found = sharding.with_shard(found, "key", n, f"s{n}")
    rows = found.collect()
    for n in (24, 25, 26, 29, 37):
        count = np.bincount([r[f"s{n}"] for r in rows], minlength=n)
        assert len(count) == n and abs(count / (len(rows) / n) - 1).max() < 0.15
    assert {r["s25"] for r in rows if r["s25"] != r["s24"]} == {24}
    # further shards of the third region take rows into it, and move none between the others
    for a, b in itertools.pairwise((25, 26, 29)):
        assert all(r[f"s{b}"] >= 24 for r in rows if r[f"s{a}"] != r[f"s{b}"])


def test_sharding_of_odd_rows(spark):
    docs = documents(spark)
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count()
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert sharding.assign(docs.limit(0)).count() == 0


def test_warc_query_equals_sql(spark):
    assert compare(QUERIES["op8_warc"](spark, SMALL), connect(SMALL), ORACLE["op8_warc"]) == []


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (1, "http://a/x y?q=é", "same"), (2, "u", "same"), (3, None, None), (4, "x", ""), (5, "http://a\r\nX: 1", "one"), (5, "q", "one"),
    (None, "z", "one"), (7, "l", "é long \r\n\r\n page " * 9000), (8, "l", "WARC/1.1\r\n\r\n"),
]


def test_records_come_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 1)
    df = spark.createDataFrame([(*p, "c", "c") for p in PAGES], "page_id long, url string, html string, sha string, first string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(df.repartition(3), folder)
    rows = warc.read_records(spark, folder).collect()
    want = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        revisit = page != first
        want.append((page, len((html or "").encode()), _digest(html), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    # the index names the bytes of each record, and archives are whole gzip files
    for r in index.collect():
        with open(tmp_path / "w" / "archives" / r["archive"], "rb") as f:
            f.seek(r["offset"])
            headers, block = warc.parse(zlib.decompress(f.read(r["length"]), 31))
        assert headers["WARC-Payload-Digest"] == f"sha1:{r['digest']}" and headers["WARC-Type"] == r["record_type"]
        assert r["record_type"] == "revisit" or _digest(block.decode()) == r["digest"]
    data = b"".join(gzip.open(tmp_path / "w" / "archives" / a).read() for a in os.listdir(tmp_path / "w" / "archives") if a.endswith("gz"))
    assert data.count(b"WARC-Record-ID") == len(PAGES)
    some = index.where("page_id = 7 or page_id = 2")
    assert sorted(r["page_id"] for r in warc.read_records(spark, folder, some).collect()) == [2, 7]
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_ranges_join_near_records_and_stay_bounded():
    entries = [(0, 10), (10, 5), (200_000, 7), (200_010, 8), (900_000, warc.RANGE * 2), (900_000 + warc.RANGE * 2, 3)]
    found = list(warc._ranges(entries))
    assert [e for _, _, held in found for e in held] == entries
    assert [(s, e) for s, e, _ in found][:2] == [(0, 15), (200_000, 200_018)]
    assert all(e - s <= warc.RANGE or len(held) == 1 for s, e, held in found)


def test_a_wrong_payload_is_noticed():
    good = warc.record(1, "u", b"abc", warc.payload_digest(b"abc"), None, False)
    assert warc._said([good]).num_rows == 1
    with pytest.raises(ValueError, match="digest"):
        warc._said([good.replace(b"abc", b"abd")])
    with pytest.raises(ValueError, match="length"):
        warc.parse(good[:-2])


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _edits(rows):
    """Brute force over rows ordered by descending id: (text, edited, next)."""
    out = []
    for k, text in enumerate(rows):
        following = rows[(k + 1) % len(rows)]
        cut = len(text) // 3
        out.append((text, text[: len(text) - cut] + following[:cut], following))
    return out


@pytest.mark.parametrize("chunk_rows", [7, 500])
def test_fingerprints_against_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (chunk_rows,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    query = QUERIES["op10_fingerprints"](spark, SMALL)
    rows = query.orderBy(F.desc("doc_id")).collect()
    plan = query._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    error, seen = [], {}
    for r, (text, edited, following) in zip(rows, _edits([d["text"] for d in docs]), strict=True):
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 256
        error += [r["near_edited"] - _jaccard(text, edited), r["near_next"] - _jaccard(text, following)]
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.06 and np.abs(error).max() < 0.25
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_odd_rows(spark):
    docs = documents(spark)
    rows = fingerprints.with_edits(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[7]["fingerprint"] == "" and by[2]["n_chars"] == 0
    assert by[1]["fingerprint"] == by[4]["fingerprint"] != by[9]["fingerprint"]
    assert by[3]["near_next"] == 1.0  # two texts without a word
    assert by[7]["near_next"] == 0.0  # one
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.with_edits(docs.limit(0)).count() == 0
    alone = fingerprints.with_edits(docs.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] < 1.0
    unnamed = fingerprints.with_edits(docs.where("doc_id is null")).collect()
    assert len(unnamed) == 2


def test_sparse_texts_agree_as_often_as_they_should(spark):
    """Short texts leave most bins to densification."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(150):
        shared = [f"s{k}x{i}" for i in range(30)]
        rows.append((k, " ".join(shared[:20]), " ".join(shared[:20] + [f"t{k}x{i}" for i in range(rng.integers(0, 20))])))
    df = spark.createDataFrame(rows, "id long, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    found = df.select("a", "b", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).collect()
    error = [r["near"] - _jaccard(r["a"], r["b"]) for r in found]
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.15
