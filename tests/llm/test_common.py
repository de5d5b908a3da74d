import numpy as np
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_sample, components, gapless, local_stars


def _groups(n, i, j):
    label = list(range(n))
    for a, b in zip(i, j, strict=True):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def test_local_stars_are_the_components():
    rng = np.random.default_rng(1)
    for n, m in [(1, 0), (10, 3), (40, 30), (40, 200)]:
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        assert local_stars(n, i, j).tolist() == _groups(n, i, j)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (100, 100), (7, 6), (100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_gapless_numbers_over_blocks(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(2).alias("g"), (F.col("id") % 300).alias("id"))
    rows = gapless(df, "g", ["id"], "n", block_rows=50).collect()
    for g in (1, 2):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(700 if g == 1 else 300))
    assert gapless(df.limit(0), "g", ["id"], "n").count() == 0


def test_sample_is_bounded_and_even(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("g"))
    found = dict(bounded_sample(df, F.col("id"), 1000, df.groupBy("g").count(), "g").groupBy("g").count().collect())
    assert found["rare"] == 200 and 600 < found["common"] < 1000
