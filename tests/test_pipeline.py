"""The whole run on the smallest test tables read as a season competition."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from leaguelens.catalog import fixture as fx
from leaguelens.operators.quality import check_leakage, check_schema_parity
from leaguelens.plans import pipeline as pl
from leaguelens.session import checkpointed

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def staged(spark):
    rows = fx.fact(spark, FOLDER).join(fx.dim_entity(spark, FOLDER), "entity_id")
    rows = checkpointed(rows.join(fx.dim_team(spark, FOLDER), "team_id").withColumnRenamed("entity_name", "entity"))
    by_team = rows.groupBy("season", "period_num", F.col("team_name").alias("team"))
    return {
        "entity_points": rows.select("season", "period_num", "entity", "points"),
        "entity_prices": rows.select("season", "period_num", "entity", "price"),
        "team_points": by_team.agg(F.sum("points").alias("points")),
        "team_prices": by_team.agg(F.avg("price").alias("price")),
        "placements": rows.select(
            "season",
            "period_id",
            "entity",
            F.col("team_name").alias("team"),
            F.col("position").cast("double").alias("finish_position"),
            F.lit("Finished").alias("status"),
            *[F.lit(0).alias(c) for c in ("dns", "dnf", "dsq", "nc")],
        ),
        "seeds": rows.select("period_id", "entity_id", "seed_position", F.lit(1).alias("seed_laps")),
        "dim_entity": fx.dim_entity(spark, FOLDER),
        "dim_team": rows.select("season", (F.col("season") * 1000 + F.col("team_id")).alias("team_id"), "team_name").distinct(),
        "dim_period": fx.dim_period(spark, FOLDER),
    }


def test_run_and_scoring_frames(spark, staged):
    checks = {"entity_fact": pl.SUITE["entity_fact"], "team_fact": pl.SUITE["team_fact"]}
    built = pl.run(spark, staged, tempfile.mkdtemp(prefix="leaguelens-run-"), checks=checks)
    n = staged["entity_points"].count()
    assert built["entity_fact"].count() == built["entity_features"].count() == n
    assert built["staged_rating"].filter("rating_before IS NULL").count() == 0
    entity, team = pl.score_frames(staged, built, 2001, 5)
    assert entity.count() > 0 and team.count() > 0
    assert check_schema_parity(built["entity_features"], entity).count() == 0
    assert check_schema_parity(built["team_features"], team).count() == 0
    assert check_leakage(entity, ["points", "status", "rating_after", "rating_delta"]).count() == 0


def test_failed_checks_raise(spark, staged):
    checks = {"entity_features": {"coverage": (["season", "period_id"], "entity_id", 10_000)}}
    with pytest.raises(ValueError, match="checks failed"):
        pl.run(spark, staged, tempfile.mkdtemp(prefix="leaguelens-run-"), checks=checks)


def test_refresh_in_two_steps_equals_one_build(spark, staged):
    checks = {"entity_fact": {"grain": ["period_id", "entity_id"]}}
    period = F.col("season") * 100 + F.col("period_num")
    cut = 199806

    def upto(name, df, late):
        if name in ("dim_entity", "dim_team", "dim_period"):
            return df
        time = F.col("period_id") if "period_id" in df.columns else period
        # the second delivery repeats a year of the first
        return df.filter(time > cut - 100) if late else df.filter(time <= cut)

    home = tempfile.mkdtemp(prefix="leaguelens-run-")
    pl.refresh(spark, {k: upto(k, v, False) for k, v in staged.items()}, home, checks=checks)
    two = pl.refresh(spark, {k: upto(k, v, True) for k, v in staged.items()}, home, checks=checks)
    one = pl.run(spark, staged, tempfile.mkdtemp(prefix="leaguelens-run-"), checks=checks)
    for name in ("entity_fact", "team_fact", "staged_rating"):
        cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in one[name].dtypes]
        a, b = one[name].select(*cols), two[name].select(*cols)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_resume_keeps_what_is_complete(spark, staged, tmp_path):
    home, df = f"file://{tmp_path}", spark.range(3)
    pl.Stages(spark, home).write("a", df)
    again = pl.Stages(spark, home, resume=True)
    assert again.write("a", df.limit(1)).count() == 3  # complete, so it stays
    assert again.write("b", df.limit(2)).count() == 2
    assert again.resume is False and again.write("a", df.limit(1)).count() == 1


def test_prediction_run_writes_every_log(spark, staged):
    from leaguelens.plans import models as ml
    from leaguelens.plans.runs import export_marts, prediction_run
    from leaguelens.sources.logs import read_log

    built = pl.run(spark, staged, tempfile.mkdtemp(prefix="leaguelens-run-"), checks={})
    entity, _ = pl.score_frames(staged, built, 2001, 5)
    home = tempfile.mkdtemp(prefix="leaguelens-logs-")
    meta = {"model_version": "v1", "feature_set_version": "f1", "target": "points", "is_production_run": True}
    feats = ml.Features(["price", "points_last_5_avg"], ["team_id"])
    for k in (1, 2):
        run = prediction_run(
            built["entity_features"], entity, feats, ml.make_regressors(["Linear"]), home, "entity", "2026-01-02 03:04:05", meta, 1
        ).collect()
        assert [r["prediction_run_id"] for r in run] == [k] and run[0]["model_name"] == "Linear"
    logged = read_log(spark, home, "entity_predictions")
    assert logged.groupBy("prediction_run_id").count().count() == 2 and logged.count() == 2 * entity.count()
    assert logged.filter("predicted_points IS NULL").isEmpty()
    assert read_log(spark, home, "model_results").count() == read_log(spark, home, "naive_baselines").count() == 2
    mart = logged.select("prediction_run_id", "predicted_points", "entity_id")
    export_marts({"entity_predictions": mart}, f"{home}/marts")
    values = [(r[0], -r[1]) for r in spark.read.parquet(f"{home}/marts/entity_predictions").collect()]
    assert values == sorted(values)


def test_suite_covers_all_tables():
    assert len(pl.SUITE) == 13 and all(r["grain"] and r["columns"] for r in pl.SUITE.values())
