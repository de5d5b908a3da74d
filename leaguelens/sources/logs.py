"""Append-only run logs with declared columns and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.common import Order, as_list, number_rows
from leaguelens.operators.keys import next_run_id
from leaguelens.sources.tables import append_table, read_or_empty

_QUANTILES = "p05 double, p10 double, p25 double, median double, p75 double, p90 double, p95 double"

# The logs' columns.
LOGS = {
    "prediction_run": "prediction_run_id bigint, created_at timestamp, model_name string, "
    "model_version string, feature_set_version string, target string, "
    "train_cutoff_period_id bigint, asset_type string",
    "entity_predictions": "prediction_run_id bigint, prediction_timestamp timestamp, "
    "model_name string, model_version string, feature_set_version string, target string, "
    "train_cutoff_period_id bigint, is_production_run boolean, season int, period_id bigint, "
    "entity_id bigint, team_id bigint, price double, predicted_points double",
    "team_predictions": "prediction_run_id bigint, prediction_timestamp timestamp, "
    "model_name string, model_version string, feature_set_version string, target string, "
    "train_cutoff_period_id bigint, is_production_run boolean, season int, period_id bigint, "
    "team_id bigint, price double, predicted_points double",
    "model_results": "prediction_run_id bigint, model_type string, cv_mae double, "
    "cv_mae_std double, train_mae double, train_rmse double, test_mae double, test_rmse double, "
    "expected_improvement double, realized_improvement double, overfit_underfit double, "
    "rmse_overfit_underfit_gap double, generalization double",
    "naive_baselines": "prediction_run_id bigint, test_mae double, test_rmse double",
    "selection_run": "selection_run_id bigint, created_at timestamp, season int, period_id bigint, "
    "selection_name string, entity_prediction_run_id bigint, team_prediction_run_id bigint, "
    "budget double, points_col string, profile_source string, profile_strategy string, "
    "optimization_target string, require_entity_from_each_team boolean, "
    "min_entities_per_chosen_team int, free_transfers int, total_transfers bigint, "
    "paid_transfers bigint, penalty double, use_bonus boolean, bonus_entity_id bigint, "
    "total_price double, gross_points double, net_points double, is_production_run boolean",
    "selection_rows": "selection_run_id bigint, asset_type string, slot_num bigint, "
    "asset_id bigint, team_id bigint, price double, points double, is_bonus boolean, "
    "is_transfer_in boolean",
    "simulation_run": "simulation_run_id bigint, created_at timestamp, period_id bigint, "
    "entity_prediction_run_id bigint, team_prediction_run_id bigint, n_sims int, "
    "random_seed int, residual_source_table string, residual_bucket_strategy string, notes string",
    "simulation_entities": "simulation_run_id bigint, period_id bigint, entity_id bigint, "
    "team_id bigint, price double, predicted_points double, prediction_bucket string, "
    f"mean_simulated_points double, std_simulated_points double, {_QUANTILES}, "
    "mean_per_price double, p90_per_price double, risk_range double, downside_gap double",
    "simulation_profiles": "simulation_run_id bigint, profile_name string, profile_source string, "
    "profile_strategy string, selection_run_id bigint, mean_selection_points double, "
    f"std_selection_points double, {_QUANTILES}",
}


def log_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(LOGS[name])


def read_log(spark: SparkSession, home: str, name: str) -> DataFrame:
    """A log's rows; none before its first append."""
    return read_or_empty(spark, f"{home}/{name}", log_schema(name))


def append_log(df: DataFrame, home: str, name: str) -> None:
    """Append to a log under its declared columns and types; absent columns are NULL."""
    fields = log_schema(name).fields
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    append_table(df.select(*cols), f"{home}/{name}", [f.name for f in fields])


def number_runs(runs: DataFrame, log: DataFrame, id_col: str, order: Order) -> DataFrame:
    """Give each new run the next id of its log."""
    first = next_run_id(log, id_col).scalar()
    out = number_rows(runs, [], order, id_col)
    return out.withColumn(id_col, F.col(id_col) + first - 1)


def log_selections(
    best: DataFrame,
    rows: DataFrame,
    home: str,
    created_at: Column,
    meta: dict[str, object],
    group: Order = "period_id",
) -> DataFrame:
    """Log selections found by ``best_selection`` and their rows; returns the numbered runs."""
    group = as_list(group)
    log = read_log(best.sparkSession, home, "selection_run")
    runs = number_runs(best, log, "selection_run_id", group).withColumns(
        {
            "created_at": created_at,
            "use_bonus": F.col("bonus_entity_id").isNotNull(),
            **{k: F.lit(v) for k, v in meta.items()},
        }
    )
    append_log(runs, home, "selection_run")
    # numbered again from the log, so that both tables share what was written
    ids = read_log(best.sparkSession, home, "selection_run").join(
        log.select("selection_run_id"), "selection_run_id", "left_anti"
    )
    keyed = rows.join(ids.select("selection_run_id", *[g for g in group if g in ids.columns]), group)
    append_log(keyed, home, "selection_rows")
    return ids


def log_simulation(
    summary: DataFrame,
    profiles: DataFrame,
    home: str,
    period_id: int,
    created_at: Column,
    meta: dict[str, object],
) -> DataFrame:
    """Log one simulation run with its entity and profile summaries; returns the run row."""
    spark = summary.sparkSession
    log = read_log(spark, home, "simulation_run")
    run = next_run_id(log, "simulation_run_id").select(
        F.col("next_simulation_run_id").alias("simulation_run_id"),
        created_at.alias("created_at"),
        F.lit(period_id).cast("long").alias("period_id"),
        *[F.lit(v).alias(k) for k, v in meta.items()],
    )
    run_id = run.first()["simulation_run_id"]
    append_log(summary.withColumn("simulation_run_id", F.lit(run_id)), home, "simulation_entities")
    append_log(profiles.withColumn("simulation_run_id", F.lit(run_id)), home, "simulation_profiles")
    # the run row comes last: a run that is listed is complete
    fixed = run.drop("simulation_run_id").withColumn("simulation_run_id", F.lit(run_id))
    append_log(fixed, home, "simulation_run")
    return read_log(spark, home, "simulation_run").filter(F.col("simulation_run_id") == run_id)
