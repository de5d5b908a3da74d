import numpy as np
import pytest

import corpus_pipeline
from leaguelens.llm import near_copies
from leaguelens.llm.common import local_stars

FOLDER = "/root/testdata/sf0.01"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Places of the rows that stay, by brute force: least id, null last, of each component."""
    sets = [_shingles(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common * 5 >= (len(a) + len(sets[j]) - common) * 4:
                links.append((i, j))
    label = local_stars(len(rows), *np.array(links, int).reshape(-1, 2).T)
    best = {}
    for place, group in enumerate(label.tolist()):
        rank = (rows[place][0] is None, rows[place][0] or 0)
        best[group] = min(best.get(group, (rank, place)), (rank, place))
    return sorted(place for _, place in best.values())


def test_the_stage_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(rows[k][0] for k in _kept(rows))


@pytest.mark.parametrize("centre_bands", [(), near_copies.CENTRE_BANDS])
def test_a_crowd_of_near_copies_equals_brute_force(spark, monkeypatch, centre_bands):
    monkeypatch.setattr(near_copies, "CENTRE_BANDS", centre_bands)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(240):
        words = [f"w{k % 6}x{i}" for i in range(120)]
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            words[at] = f"new{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect()) == _kept(rows)


@pytest.mark.parametrize(("block_rows", "block_shingles"), [(512, 1 << 19), (50, 2000)])
def test_a_crowd_of_like_but_different_texts(spark, monkeypatch, block_rows, block_shingles):
    """Most pairs lie between 0.6 and 0.9, so that stars leave much to the comparison inside tasks."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", block_shingles)
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", 300)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        words = [f"w{k % 2}x{i}" for i in range(150)]
        for at in rng.choice(150, rng.integers(2, 9), replace=False):
            words[at] = f"new{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    rows += [(1000, ""), (1001, "  "), (1002, None), (1003, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.groups(docs)
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect()) == [rows[k][0] for k in _kept(rows)]
    assert found.count() > 20


def test_exact_comparison_equals_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(60, rng.integers(0, 50))).astype(np.uint64) for _ in range(40)]
    import pyarrow as pa

    held = pa.chunked_array([pa.array([x.tobytes() for x in sets], pa.binary())])
    sig = np.zeros((40, 96), np.uint16)
    label, n = np.arange(40), np.array([len(x) for x in sets])
    i, j = near_copies._exactly(np.arange(40), np.arange(40), label, n, sig, held)
    want = {(a, b) for a in range(40) for b in range(40) if a != b and near_copies.similar(sets[a], sets[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
