"""Runs that end in logs and exports: predictions, and all marts."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.keys import next_run_id
from leaguelens.plans.marts import MART_ORDER
from leaguelens.plans.models import (
    Features,
    fit_and_rank,
    log_performance,
    naive_baseline,
    save_model,
    score,
    split_last_periods,
)
from leaguelens.sources.logs import append_log, read_log
from leaguelens.sources.tables import export_mart


def prediction_run(
    history: DataFrame,
    frame: DataFrame,
    feats: Features,
    models: dict[str, Estimator],
    home: str,
    asset_type: str,
    created_at: str,
    meta: dict[str, object],
    folds: int = 5,
) -> DataFrame:
    """Train on ``history``, score the upcoming ``frame`` and log it all; returns the run's row.

    ``home`` holds the logs and the model of each run. ``meta`` has model_version,
    feature_set_version, target and is_production_run. Results, baseline and predictions
    are appended before the run row, so a run that is listed is complete.
    """
    spark = history.sparkSession
    run_id = next_run_id(read_log(spark, home, "prediction_run"), "prediction_run_id").first()[0]
    results, best, model = fit_and_rank(models, history, feats, folds=folds)
    save_model(model, {"model_name": best, "features": feats.all, "asset_type": asset_type}, f"{home}/models/{run_id}")
    stamp = F.lit(created_at).cast("timestamp")
    own = {
        "prediction_run_id": F.lit(run_id),
        "model_name": F.lit(best),
        "train_cutoff_period_id": F.lit(history.agg(F.max("period_id")).first()[0]),
        **{k: F.lit(v) for k, v in meta.items()},
    }
    naive = naive_baseline(*split_last_periods(history)).withColumn("prediction_run_id", F.lit(run_id))
    append_log(naive, home, "naive_baselines")
    rows = results.withColumns({"prediction_run_id": F.lit(run_id), "model_type": F.col("model")})
    append_log(log_performance(rows, naive), home, "model_results")
    scored = score(model, frame, feats).withColumns({**own, "prediction_timestamp": stamp})
    append_log(scored, home, f"{asset_type}_predictions")
    run = spark.range(1).select(*[c.alias(n) for n, c in own.items()], stamp.alias("created_at"))
    append_log(run.withColumn("asset_type", F.lit(asset_type)), home, "prediction_run")
    return read_log(spark, home, "prediction_run").filter(F.col("prediction_run_id") == run_id)


def export_marts(marts: dict[str, DataFrame], home: str) -> None:
    """Write marts sorted as ``MART_ORDER`` says, each a table of its own."""
    unknown = set(marts) - set(MART_ORDER)
    if unknown:
        raise KeyError(f"no order for {sorted(unknown)}")
    for name, mart in marts.items():
        export_mart(mart, f"{home}/{name}", MART_ORDER[name])
