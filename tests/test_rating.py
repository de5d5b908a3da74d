"""Ratings: batch plans, the stream and a plain fold agree."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.plans import rating as rt
from leaguelens.streaming.rating_stream import open_ratings, stream_rating

P = rt.RatingParams()


def fold(rows):
    """The rating rules as a loop over pairs."""
    rating, last, out, previous = {}, {}, {}, None
    for season, period in sorted({(s, p) for s, p, _, _ in rows}):
        if previous is not None and season != previous:
            rating = {e: P.init + P.season_shrink * (r - P.init) for e, r in rating.items()}
        field = [(e, pos) for s, p, e, pos in rows if (s, p) == (season, period)]
        before = {}
        for e, _ in field:
            away = max(0, season - last[e] - 1) if e in last else 0
            before[e] = P.init + P.inactivity_shrink**away * (rating.get(e, P.init) - P.init)
        for e, pos in field:
            move = 0.0
            for o, other in field:
                if o != e:
                    actual = 1.0 if pos < other else 0.5 if pos == other else 0.0
                    move += P.k * (actual - 1 / (1 + 10 ** ((before[o] - before[e]) / 400)))
            out[(season, period, e)] = (before[e], move, before[e] + move)
        for e, _ in field:
            rating[e], last[e] = out[(season, period, e)][2], season
        previous = season
    return out


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(11)
    rows = []
    for pool in ("x", "y"):
        for season in (2020, 2021, 2023, 2024):
            if pool == "y" and season == 2021:
                continue
            for period in range(1, 3):
                for e in range(9):
                    if rng.random() < 0.8 and not (e == 0 and season in (2021, 2023)):
                        rows.append((pool, season, season * 100 + period, f"e{e}", float(rng.randint(1, 6))))
    return rows, spark.createDataFrame(
        rows, "pool string, season int, period_id long, entity string, rating_position double"
    )


def want(rows):
    out = {}
    for pool in ("x", "y"):
        part = fold([r[1:] for r in rows if r[0] == pool])
        out |= {(pool, *k): v for k, v in part.items()}
    return out


def close(df, expected):
    got = {
        (r["pool"], r["season"], r["period_id"], r["entity"]): [r[c] for c in rt.RATING_COLUMNS]
        for r in df.collect()
    }
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert np.allclose(got[k], v, rtol=0, atol=1e-8), k


def test_grouped_plan(results):
    close(rt.sequential_rating(results[1], "pool"), want(results[0]))


def test_period_plan(results):
    close(rt.sequential_rating(results[1], "pool", pool_rows=10), want(results[0]))


def test_period_plan_with_rating_cells(results):
    close(rt.sequential_rating(results[1], "pool", pool_rows=10, period_rows=2), want(results[0]))


def test_stream_equals_batch(spark, results):
    home = tempfile.mkdtemp(prefix="leaguelens-test-")
    rows, df = results
    times = sorted({(r[1], r[2]) for r in rows})
    of = {t: k for k, t in enumerate(times)}
    # in order of time, each file with half of one period and half of the next
    for k in range(len(times) + 1):
        part = [r for r in rows if of[r[1], r[2]] + (r[3] in ("e1", "e3", "e5", "e7")) == k]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    stream_rating(stream, home, "pool", "entity", f"{home}/cp").awaitTermination()
    closed = spark.read.parquet(f"{home}/rated")
    assert closed.agg(F.max("period_id")).first()[0] < times[-1][1]
    last = open_ratings(spark, df.schema, home, "pool", "entity", len(times))
    close(closed.select(*last.columns).unionByName(last), want(rows))


@pytest.mark.parametrize(
    ("batches", "message"),
    [
        ([[(2020, 1, "a", 1.0), (2020, 1, "b", 2.0)], [(2020, 2, "a", 1.0)], [(2020, 1, "c", 3.0)]], "late result"),
        ([[(2020, 1, "a", 1.0)], [(2020, 1, "a", 2.0)], [(2020, 2, "b", 1.0)]], "repeated entity"),
    ],
)
def test_stream_raises_on_late_and_repeated_results(spark, batches, message):
    home = tempfile.mkdtemp(prefix="leaguelens-test-")
    schema = "season int, period_id long, entity string, rating_position double"
    for rows in batches:
        spark.createDataFrame([("p", *r) for r in rows], f"pool string, {schema}").coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(f"pool string, {schema}").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    with pytest.raises(Exception, match=message):
        stream_rating(stream, home, "pool", "entity", f"{home}/cp").awaitTermination()


def test_single_pool_and_zero_sum(results):
    one = results[1].filter("pool = 'x'").drop("pool")
    out = rt.sequential_rating(one)
    assert "__pool" not in out.columns
    sums = out.groupBy("season", "period_id").agg(F.sum("rating_delta").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-9 for r in sums)


def test_repeated_entity_raises(spark):
    rows = [(2020, 1, "a", 1.0), (2020, 1, "a", 2.0)]
    df = spark.createDataFrame(rows, "season int, period_id long, entity string, rating_position double")
    with pytest.raises(Exception, match="repeated entity"):
        rt.sequential_rating(df).collect()


def test_cells_match_direct_sum_over_a_wide_range(spark):
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.normal(1500, 150, 700), rng.uniform(-30000, 40000, 300)])
    pos = rng.integers(1, 400, len(r)).astype(float)
    df = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r, pos, strict=True))],
        "entity int, rating_before double, rating_position double",
    ).withColumn("period_id", F.lit(1))
    out = rt.matchup_totals(df, "period_id", "entity", period_rows=10).orderBy("entity").toPandas()
    assert np.abs(out["expected"] - rt.expected_directly(r, 400.0)).max() < 1e-8
    assert np.abs(out["actual"] - rt.actual_directly(pos)).max() == 0


def test_resolve_positions(spark):
    rows = [
        (1, "a", "1", False, False, False, False),
        (1, "b", "2", None, None, None, None),
        (1, "c", None, False, True, False, False),  # retired: one behind the last
        (1, "d", "", False, False, True, False),  # disqualified: two behind
        (1, "e", None, False, False, False, True),  # not classified: one behind
        (1, "f", None, True, False, False, False),  # did not start
        (1, "g", None, False, False, False, False),  # unresolved
        (1, "a", "5", False, False, False, False),  # the better row of a stays
        (2, "a", None, False, True, False, False),  # nobody classified: dropped
    ]
    schema = "period_id int, entity string, position string, dns boolean, dnf boolean, dsq boolean, nc boolean"
    out = rt.resolve_positions(spark.createDataFrame(rows, schema), "period_id")
    got = {(r["period_id"], r["entity"]): r["rating_position"] for r in out.collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (1, "c"): 6, (1, "d"): 7, (1, "e"): 6}


def test_expand_rating_carries_and_defaults(spark):
    rating = spark.createDataFrame(
        [(2, 7, 1500.0, 8.0, 1508.0)],
        "period_id long, entity_id long, rating_before double, rating_delta double, rating_after double",
    )
    spine = spark.createDataFrame([(p, 7) for p in (1, 2, 3)] + [(1, 8)], "period_id long, entity_id long")
    out = {(r["entity_id"], r["period_id"]): tuple(r[c] for c in rt.RATING_COLUMNS) for r in rt.expand_rating(rating, spine).collect()}
    assert out[(7, 1)] == (1500.0, 0.0, 1500.0)
    assert out[(7, 2)] == (1500.0, 8.0, 1508.0)
    assert out[(7, 3)] == (1508.0, 0.0, 1508.0)
    assert out[(8, 1)] == (1500.0, 0.0, 1500.0)


def test_large_periods_are_rated_within_a_task(spark):
    rng = np.random.default_rng(8)
    rating = np.r_[rng.normal(1500, 300, 4000), rng.normal(-40_000, 900, 2500)]
    with np.errstate(over="ignore"):
        want = rt.expected_directly(rating, 400.0)
    np.testing.assert_allclose(rt.expected_in_task(rating, 400.0), want, atol=1e-8)
    df = spark.createDataFrame([(1, k, float(k), float(r)) for k, r in enumerate(rating)], "period_id int, entity int, rating_position double, rating_before double")
    out = rt.matchup_totals(df, "period_id", "entity")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = out.orderBy("entity").toPandas()
    np.testing.assert_allclose(got["expected"], want, atol=1e-8)


def test_state_is_not_broadcast(spark):
    schema = "pool int, entity long, season int, period_id int, rating_position double"
    one = spark.createDataFrame([(1, 1, 2020, 1, 1.0), (1, 2, 2020, 1, 2.0)], schema)
    state = spark.range(1, 3).selectExpr("1 AS pool", "id AS entity", "1510.0D AS rating", "2019 AS last_season", "0 AS changes")
    plan = rt.rating_step(state, one, "pool", "entity", clock=state)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
