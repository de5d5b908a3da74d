import numpy as np
import pytest
import xxhash

from leaguelens.llm import simhash, vectors
from leaguelens.llm.common import components, local_stars
from leaguelens.llm.queries import QUERIES
from tests.llm.frames import SMALL, TEXTS, documents


def _plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [t for _, t, _ in TEXTS if t and len(t) < 1000] + ["A b C", "one two", "É é", "a\x0bb\x0cc d"])
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text.encode()) == _plain(text)


def test_fingerprint_of_a_long_text_is_read_whole(monkeypatch):
    text = b"a b c d e f g " * 50 + b"the end"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("subtree_rows", [20_000, 6])
def test_trie_join_equals_all_pairs(spark, subtree_rows):
    rng = np.random.default_rng(2)
    prints = {0}
    for base in rng.integers(0, 2**63, 60, dtype=np.int64).tolist():
        prints.add(base)
        for _ in range(6):
            x = base
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    # a crowd that shares its upper bits
    crowd = rng.integers(0, 2**12, 200).tolist()
    prints |= {(5 << 50) | x for x in crowd}
    fps = np.array(sorted(prints), np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.BUDGET)
    signed = fps.view(np.int64)
    label = local_stars(len(fps), i, j)
    want = {}
    for x, group in zip(signed.tolist(), label.tolist(), strict=True):
        want.setdefault(group, set()).add(x)
    df = spark.createDataFrame([(x, x) for x in signed.tolist()], "fp long, id long")
    got = {}
    for r in components(simhash.links(df, subtree_rows), "u", "v").collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ids = [r["doc_id"] for r in docs]
    fps = np.array([_plain(r["text"]) for r in docs], np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.BUDGET)
    order = np.argsort(ids)
    place = np.argsort(order)
    label = local_stars(len(ids), place[i], place[j])
    want = {d: (f"{int(fps[k]):016x}", ids[order[label[place[k]]]]) for k, d in enumerate(ids)}
    rows = QUERIES["op9_simhash_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want and len(rows) == len(ids)


def test_simhash_of_odd_rows(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[4] and by[2] == by[3] == by[7] == {("0" * 16, 2)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()].count(4) == 0 and kept.where("doc_id = 1").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * rng.standard_normal((200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turn = vectors.rotation(vectors.code_bits(64))
    assert np.allclose(turn @ turn.T, np.eye(len(turn)), atol=1e-5)
    guess, error = vectors.estimates(*vectors.encode(unit, turn), unit, turn)
    off = guess - unit @ unit.T
    assert abs(off.mean()) < 2e-3
    assert (np.abs(off) <= error).mean() > 0.9995


def _brute(rows, threshold=vectors.THRESHOLD):
    links, pairs = np.zeros(len(rows), int), []
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows):
            if a == b or x is None or y is None or len(x) != len(y):
                continue
            if any(v is None or not np.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            p, q = np.array(x, float), np.array(y, float)
            if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold:
                links[a] += 1
                pairs.append((a, b))
    label = local_stars(len(rows), *np.array(pairs, int).reshape(-1, 2).T)
    return links, label


def test_vector_groups_in_many_small_cells(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 24))
    near = [base[k % 40] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.2]) for k in range(200)]
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate([*base, *near])]
    links, label = _brute(rows)
    df = spark.createDataFrame(rows, "id long, x array<double>").selectExpr("id", "x", "1L as copies")
    parts = vectors.links(df, cell_rows=20, block_rows=16).collect()
    got = np.zeros(len(rows), int)
    for r in parts:
        got[r["id"]] += r["links"]
    assert (got <= links).all() and got.sum() >= 0.98 * links.sum()
    one = vectors.links(df, cell_rows=10_000, block_rows=37).collect()
    got = np.zeros(len(rows), int)
    for r in one:
        got[r["id"]] += r["links"]
    assert (got == links).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.01, 0.0]), (12, [0.0, 1.0]), (13, [0.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "vec_id long, embedding array<float>, x string, id string, key string")
    links, label = _brute(rows)
    found = vectors.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == sorted(
        (rows[k][0], int(links[k]), rows[label[k]][0], rows[k][0] == rows[label[k]][0]) for k in range(len(rows))
    )
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.selectExpr("cast(null as long) as vec_id", "embedding")).where("kept").count() == len(rows)


def test_vector_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    links, label = _brute(rows)
    found = QUERIES["op4_embedding_dedup"](spark, SMALL).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in found] == [(int(n), rows[k][0]) for n, k in zip(links, label, strict=True)]
