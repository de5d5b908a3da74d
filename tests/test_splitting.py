"""The range-partitioned plans for large groups return what the plain ones return."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leaguelens.operators.aggregates import collect_sorted, dist_summary
from leaguelens.operators.common import fits_one_task, number_rows, running_total
from leaguelens.operators.joins import asof_carry
from leaguelens.operators.windows import (
    change_and_pct,
    dense_rank_desc,
    forward_fill,
    lag_lead,
    season_to_date_mean,
    trailing_count_guard,
    trailing_mean,
    trailing_mean_lagged,
    trailing_std,
)


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds two thirds of the rows; there are NULL values and a NULL key."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3)
        rows.append((key, i // 3, i, value, i % 2))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, id int, v double, season int").repartition(4).cache()


def same(a, b):
    def norm(df):
        cols = sorted(df.columns)
        rows = [tuple(r[c] for c in cols) for r in df.collect()]
        rows = [tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in rows]
        return sorted(rows, key=repr)

    assert norm(a) == norm(b)


ORDER = ["t", "id"]
OPS = {
    "number": lambda df, m: number_rows(df, "k", ORDER, "n", m),
    "number_all": lambda df, m: number_rows(df, [], ["-t", "id"], "n", m),
    "running": lambda df, m: running_total(df, "k", ORDER, F.col("v"), "s", m),
    "lag": lambda df, m: lag_lead(df, "k", ORDER, "v", 2, m),
    "mean": lambda df, m: trailing_mean(df, "k", ORDER, "v", 5, None, m),
    "mean_lagged": lambda df, m: trailing_mean_lagged(df, "k", ORDER, "v", 5, None, m),
    "guard": lambda df, m: trailing_count_guard(df, "k", ORDER, "v", 3, m),
    "std": lambda df, m: trailing_std(df, "k", ORDER, "v", 5, 2, None, m),
    "season": lambda df, m: season_to_date_mean(df, "k", "season", ORDER, "v", None, m),
    "fill": lambda df, m: forward_fill(df, "k", ORDER, "v", None, None, m),
    "fill_default": lambda df, m: forward_fill(df, "k", ORDER, "v", 9.0, None, m),
    "dense": lambda df, m: dense_rank_desc(df, "k", "v", None, m),
    "change": lambda df, m: change_and_pct(df, "k", ORDER, "v", m),
    "quantiles": lambda df, m: dist_summary(df, "k", "v", max_group_rows=m),
}


@pytest.mark.parametrize("name", OPS)
def test_large_group_plan(hot, name):
    same(OPS[name](hot, 1_000_000), OPS[name](hot, 20))


def test_running_total_with_leading_nulls(spark):
    rows = [("a", i, None if i < 5 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    same(running_total(df, "k", "t", F.col("v"), "s"), running_total(df, "k", "t", F.col("v"), "s", 0))


def test_lag_against_loop(hot):
    got = {(r["k"], r["id"]): r["prev_v"] for r in lag_lead(hot, "k", ORDER, "v", 1, 10).collect()}
    seen = {}
    for r in sorted(hot.collect(), key=lambda r: (r["t"], r["id"])):
        assert got[(r["k"], r["id"])] == seen.get(r["k"])
        seen[r["k"]] = r["v"]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_carry_against_loop(spark, strict):
    rng = random.Random(3)
    spine = [(rng.choice("ab"), t, i) for i, t in enumerate(rng.choices(range(50), k=80))]
    obs = sorted({(rng.choice("ab"), t) for t in rng.choices(range(50), k=40)})
    s = spark.createDataFrame(spine, "k string, t int, i int")
    o = spark.createDataFrame([(k, t, t * 10) for k, t in obs], "k string, seen int, x int")
    for limit in (1000, 5):
        out = asof_carry(s, o, "k", "t", "seen", ["seen", "x"], {"x": -1}, strict, limit)
        got = {r["i"]: (r["seen"], r["x"]) for r in out.collect()}
        for k, t, i in spine:
            past = [u for kk, u in obs if kk == k and (u < t if strict else u <= t)]
            assert got[i] == ((max(past), max(past) * 10) if past else (None, -1))


def test_collect_sorted_keeps_every_value(hot):
    parts = collect_sorted(hot.filter("k = 'hot'"), "k", "id", part_size=50).orderBy("part").collect()
    want = sorted(r["id"] for r in hot.filter("k = 'hot'").collect())
    assert [x for p in parts for x in p["id_list"]] == want
    assert len(parts) == math.ceil(len(want) / 50)


def test_season_mean_keeps_infinities_in_their_place(spark):
    values = [1.0, 2.0, float("inf"), 4.0, 5.0, 7.0, None, 9.0]
    df = spark.createDataFrame([("a", 1, i, v) for i, v in enumerate(values)], "k string, season int, t int, v double")
    same(season_to_date_mean(df, "k", "season", "t", "v"), season_to_date_mean(df, "k", "season", "t", "v", None, 0))


def test_a_hot_value_is_one_row_when_ranked(spark):
    df = spark.range(10_000).select(F.lit("k").alias("k"), F.when(F.col("id") < 9_000, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    for limit in (1_000_000, 0):
        row = dist_summary(df, "k", "v", max_group_rows=limit).first()
        assert (row["median"], row["p90"], row["p95"]) == (5.0, pytest.approx(5.0 + 0.1 * 8995), 9499.05)


def test_sizing_counts_nothing_where_the_answer_is_given(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("sizing"))
    spark.sparkContext.setJobGroup("sizing", "sizing")
    try:
        assert fits_one_task(df, "k", None) and not fits_one_task(df, "k", 0) and jobs() == 0
        assert fits_one_task(df, "k", 5) and jobs() > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
