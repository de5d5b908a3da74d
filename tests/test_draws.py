"""Draws inside the row: the same draws, and the same figures, as draws that are rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.plans import draws, pools
from leaguelens.plans import outcomes as oc


def _scores(spark, n=40):
    rows = spark.range(n).select(
        (F.col("id") % 5).alias("period_id"), F.col("id").alias("entity_id"), (F.col("id") % 3).alias("team_id"),
        (F.col("id") % 4).cast("double").alias("price"), F.when(F.col("id") != 7, F.col("id") * 1.5).alias("predicted_points"),
    )
    return rows.withColumn("prediction_bucket", oc.prediction_bucket())


def _residuals(spark, n=300):
    rows = spark.range(n).select(
        (F.col("id") % 7).alias("period_id"), F.col("id").alias("entity_id"),
        F.when(F.col("id") % 3 == 0, "00_20").otherwise("20_plus").alias("prediction_bucket"),
        (F.pmod(F.hash("id"), F.lit(1000)) / 10.0 - 50).alias("residual"),
    )
    return rows


def _close(a, b):
    left, right = (df.select(a.columns).orderBy(*a.columns[:2]).toPandas() for df in (a, b))
    assert len(left) == len(right) > 0
    for c in left.columns:
        x, y = left[c], right[c]
        if x.dtype == object:
            assert (x == y).all()
        else:
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n_sims", [1, 2, 257])
def test_outcomes_equal_draws_that_are_rows(spark, n_sims):
    scores, residuals = _scores(spark), _residuals(spark)
    want = oc.summarize_outcomes(oc.bootstrap_outcomes(scores, residuals, n_sims, 3))
    _close(want, draws.outcome_summaries(scores, residuals, n_sims, 3))


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_selections_equal_draws_that_are_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(draws, "DRAWS_AT_ONCE", at_once)
    scores, residuals = _scores(spark), _residuals(spark)
    members = scores.select(F.concat(F.lit("p"), F.col("entity_id") % 2).alias("profile"), "period_id", "entity_id")
    members = members.unionByName(scores.select(F.lit("all").alias("profile"), "period_id", "entity_id")).union(members)
    want = oc.summarize_selections(oc.selection_outcomes(oc.bootstrap_outcomes(scores, residuals, 50, 3), members))
    _close(want, draws.selection_summaries(scores, residuals, members, n_sims=50, seed=3))


def test_large_pools_take_the_join(spark, monkeypatch):
    scores, residuals = _scores(spark), _residuals(spark)
    small = draws.outcome_summaries(scores, residuals, 30, 3)
    monkeypatch.setattr(draws, "BROADCAST_ROWS", 10)
    _close(small, draws.outcome_summaries(scores, residuals, 30, 3))


def test_no_draw_is_a_row(spark):
    plan = draws.outcome_summaries(_scores(spark), _residuals(spark), 10_000, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_missing_buckets_and_empty_scores(spark):
    scores, residuals = _scores(spark), _residuals(spark)
    with pytest.raises(KeyError):
        draws.outcome_summaries(scores, residuals.where("prediction_bucket = '00_20'"), 10)
    assert draws.outcome_summaries(scores.limit(0), residuals, 10).count() == 0


def _many(monkeypatch):
    """Pools count as too many to send."""
    monkeypatch.setattr(draws, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(oc, "BROADCAST_ROWS", 10)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_residuals_are_read_in_tasks(spark, monkeypatch):
    scores, residuals = _scores(spark), _residuals(spark)
    members = scores.select(F.concat(F.lit("p"), F.col("entity_id") % 2).alias("profile"), "period_id", "entity_id")
    few = draws.selection_summaries(scores, residuals, members, n_sims=50, seed=3)
    _many(monkeypatch)
    many = draws.selection_summaries(scores, residuals, members, n_sims=50, seed=3)
    assert "Generate" not in _plan(many) and _plan(many).count("Join") == _plan(few).count("Join")
    assert "Join" not in _plan(draws.outcome_summaries(scores, residuals, 10_000, 3))
    _close(few, many)


def test_residuals_beyond_a_worker_are_read_by_pieces(spark, monkeypatch):
    scores, residuals = _scores(spark), _residuals(spark)
    members = scores.select(F.lit("all").alias("profile"), "period_id", "entity_id")
    want = draws.outcome_summaries(scores, residuals, 30, 3), draws.selection_summaries(scores, residuals, members, n_sims=30, seed=3)
    _many(monkeypatch)
    monkeypatch.setattr(pools, "HELD_ROWS", 10)
    monkeypatch.setattr(pools, "CHUNK_ROWS", 70)
    monkeypatch.setattr(pools, "DRAWS_PER_READ", 200)
    _close(want[0], draws.outcome_summaries(scores, residuals, 30, 3))
    _close(want[1], draws.selection_summaries(scores, residuals, members, n_sims=30, seed=3))


@pytest.mark.parametrize("plan", [{}, {"max_group_rows": 0}])
def test_draws_as_rows_are_not_shuffled(spark, monkeypatch, plan):
    scores, residuals = _scores(spark), _residuals(spark)
    want = oc.bootstrap_outcomes(scores, residuals, 20, 3)
    _many(monkeypatch)
    got = oc.bootstrap_outcomes(scores, residuals, 20, 3, **plan)
    assert got.columns == want.columns and "Join" not in _plan(got) and _plan(got).count("Exchange") == 1
    a, b = (df.orderBy("period_id", "entity_id", "simulation_id").toPandas() for df in (want, got))
    assert len(a) == len(b) == 39 * 20
    for c in ("entity_id", "simulation_id", "team_id", "sampled_residual", "simulated_points"):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12)
