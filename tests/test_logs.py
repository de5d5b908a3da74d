"""A selection and a simulation, from predictions to their logs."""

import tempfile

from pyspark.sql import functions as F

from leaguelens.plans import outcomes as oc
from leaguelens.plans import selection as se
from leaguelens.sources.logs import LOGS, append_log, log_schema, log_selections, log_simulation, read_log


def test_schemas_parse(spark):
    assert all(log_schema(name).fields for name in LOGS)


def test_selection_and_simulation_logs(spark):
    home = tempfile.mkdtemp(prefix="leaguelens-logs-")
    ents = spark.createDataFrame(
        [(p, e, e % 3, 5.0 + e, 3.0 * e) for p in (1, 2) for e in range(8)],
        "period_id long, entity_id long, team_id long, price double, points double",
    )
    teams = ents.groupBy("period_id", "team_id").agg(F.max("price").alias("price"), F.sum("points").alias("points"))
    budgets = spark.createDataFrame([(1, 70.0), (2, 90.0)], "period_id long, budget double")
    rules = se.SelectionRules(n_entities=3, n_teams=1, bonus_multiplier=2.0)
    now = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    meta = {"selection_name": "us", "profile_strategy": "max_points", "season": 2026, "is_production_run": False}
    assert read_log(spark, home, "selection_run").count() == 0
    for _ in range(2):
        best = se.best_selection(ents, teams, budgets, "period_id", None, rules)
        rows = se.selection_rows(best, ents, teams, "period_id")
        log_selections(best, rows, home, now, meta)
    runs = read_log(spark, home, "selection_run")
    assert sorted(r["selection_run_id"] for r in runs.collect()) == [1, 2, 3, 4]
    assert read_log(spark, home, "selection_rows").groupBy("selection_run_id").count().filter("count = 4").count() == 4
    found = se.find_existing_run(runs, {"selection_name": "us", "profile_strategy": "max_points"}).first()[0]
    assert found == 1
    assert se.find_existing_run(runs, {"selection_name": "them"}).first()[0] is None

    scores = ents.filter("period_id = 1").withColumn("predicted_points", F.col("points"))
    scores = scores.withColumn("prediction_bucket", oc.prediction_bucket())
    residuals = spark.createDataFrame(
        [(b, float(i), i, i) for b in ("00_20", "20_plus") for i in range(9)],
        "prediction_bucket string, residual double, period_id long, entity_id long",
    )
    sims = oc.bootstrap_outcomes(scores, residuals, 50).cache()
    members = (
        read_log(spark, home, "selection_rows")
        .filter("asset_type = 'entity'")
        .join(runs.filter("period_id = 1").select("selection_run_id", "period_id"), "selection_run_id")
        .select(F.col("selection_run_id").alias("profile"), "period_id", F.col("asset_id").alias("entity_id"))
    )
    profiles = oc.summarize_selections(oc.selection_outcomes(sims, members))
    profiles = profiles.withColumn("selection_run_id", F.col("profile")).withColumn("profile_name", F.lit("max"))
    run = log_simulation(oc.summarize_outcomes(sims), profiles, home, 1, now, {"n_sims": 50, "random_seed": 42})
    assert run.first()["simulation_run_id"] == 1 and run.first()["n_sims"] == 50
    entities = read_log(spark, home, "simulation_entities")
    assert entities.count() == 8 and entities.filter("p10 > p90").count() == 0
    assert read_log(spark, home, "simulation_profiles").count() == 2
    means = {r["selection_run_id"]: r["mean_selection_points"] for r in read_log(spark, home, "simulation_profiles").collect()}
    assert means[1] == means[3]


def test_append_log_casts_and_fills(spark):
    home = tempfile.mkdtemp(prefix="leaguelens-logs-")
    append_log(spark.createDataFrame([(1, 2)], "prediction_run_id int, test_mae int"), home, "naive_baselines")
    row = read_log(spark, home, "naive_baselines").first()
    assert (row["prediction_run_id"], row["test_mae"], row["test_rmse"]) == (1, 2.0, None)
