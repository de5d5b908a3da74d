"""Reporting marts (R1-R10): enriched logs, ready for ``export_mart``.

Each builder returns the mart unsorted beside its order in ``MART_ORDER``:
the sort belongs to the export, where it is one range-partitioned write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.scalars import label
from leaguelens.operators.aggregates import any_true
from leaguelens.operators.joins import star_join
from leaguelens.operators.ordering import dense_index, top_k
from leaguelens.operators.sets import union_loose
from leaguelens.plans.outcomes import REPORT_BANDS, residuals

MART_ORDER = {
    "entity_predictions": ["prediction_run_id", "-predicted_points"],
    "team_predictions": ["prediction_run_id", "-predicted_points"],
    "residuals": ["prediction_run_id", "-abs_residual"],
    "model_evaluation": ["-created_at", "asset_type", "test_mae"],
    "selection_runs": ["-created_at"],
    "sim_profiles": ["-simulation_run_id", "-mean_selection_points"],
    "sim_entities": ["-simulation_run_id", "-mean_simulated_points"],
    "sim_runs": ["-simulation_run_id"],
    "sim_selection": ["-simulation_run_id", "profile_name", "asset_type", "slot_num"],
}


def _periods(dim_period: DataFrame) -> DataFrame:
    return dim_period.select("period_id", "period_num", "period_name", "is_special")


def _entities(dim_entity: DataFrame) -> DataFrame:
    return dim_entity.select("entity_id", "entity_name", "acronym")


def _teams(dim_team: DataFrame) -> DataFrame:
    return dim_team.select("team_id", "team_name")


def mart_entity_predictions(log, dim_entity, dim_team, dim_period) -> DataFrame:
    """Logged entity predictions with names."""
    return star_join(
        log,
        [
            (_entities(dim_entity), "entity_id"),
            (_teams(dim_team), "team_id"),
            (_periods(dim_period), "period_id"),
        ],
    )


def mart_team_predictions(log, dim_team, dim_period) -> DataFrame:
    """R2: logged team predictions with names."""
    return star_join(log, [(_teams(dim_team), "team_id"), (_periods(dim_period), "period_id")])


def mart_residuals(log, fact, dim_entity, dim_team, dim_period) -> DataFrame:
    """Residuals in six bands with names."""
    actual = fact.select("period_id", "entity_id", "points")
    rows = residuals(log, actual, bands=REPORT_BANDS)
    return mart_entity_predictions(rows, dim_entity, dim_team, dim_period)


def mart_model_evaluation(results, runs, entity_log, team_log, naive) -> DataFrame:
    """Model results beside their naive baseline."""
    flags = [log.select("prediction_run_id", "is_production_run") for log in (entity_log, team_log)]
    production = any_true(union_loose(flags), "prediction_run_id", "is_production_run")
    base = naive.select(
        "prediction_run_id",
        F.col("test_mae").alias("naive_test_mae"),
        F.col("test_rmse").alias("naive_test_rmse"),
    )
    rows = star_join(results, [(runs, "prediction_run_id"), (production, "prediction_run_id"), (base, "prediction_run_id")])
    kind = F.when(F.col("model_type").isin("Random Forest", "RandomForest"), "RandomForest")
    out = {"model_type": kind.otherwise(F.col("model_type"))}
    for m in ("mae", "rmse"):
        gap = F.col(f"naive_test_{m}") - F.col(f"test_{m}")
        out[f"{m}_vs_naive"] = gap
        out[f"{m}_pct_improvement_vs_naive"] = F.try_divide(gap, F.col(f"naive_test_{m}"))
    return rows.withColumns(out)


def mart_selection_runs(runs, dim_period, dim_entity) -> DataFrame:
    """Selection runs with period and bonus entity names."""
    bonus = dim_entity.select(
        F.col("entity_id").alias("bonus_entity_id"), F.col("entity_name").alias("bonus_entity_name")
    )
    periods = dim_period.select("period_id", "period_num", "period_name", "date_start", "is_special")
    return star_join(runs, [(periods, "period_id"), (bonus, "bonus_entity_id")])


def mart_sim_profiles(results, runs, dim_period) -> DataFrame:
    """Profile results with risk range and downside gap."""
    rows = star_join(results, [(runs, "simulation_run_id"), (_periods(dim_period), "period_id")])
    return rows.withColumns(
        {
            "selection_risk_range": F.col("p90") - F.col("p10"),
            "selection_downside_gap": F.col("mean_selection_points") - F.col("p10"),
        }
    )


def mart_sim_entities(summary, runs, dim_entity, dim_team, dim_period) -> DataFrame:
    """Simulated outcome summary per entity; the period is the summary's own."""
    rows = summary.join(runs.drop("period_id"), "simulation_run_id", "left")
    return mart_entity_predictions(rows, dim_entity, dim_team, dim_period)


def mart_sim_runs(runs, dim_period) -> DataFrame:
    """Simulation run log."""
    periods = dim_period.select("period_id", "season", "period_num", "period_name", "is_special")
    return star_join(runs, [(periods, "period_id")])


def mart_sim_selection(results, runs, selections, dim_entity, dim_team, dim_period) -> DataFrame:
    """The assets behind each simulated profile that came from a selection run."""
    rows = results.filter(F.col("selection_run_id").isNotNull())
    rows = star_join(rows, [(runs.select("simulation_run_id", "period_id", "created_at"), "simulation_run_id")])
    rows = rows.join(selections, "selection_run_id", "left")
    is_entity = F.col("asset_type") == "entity"
    rows = rows.withColumn("entity_id", F.when(is_entity, F.col("asset_id")))
    return mart_entity_predictions(rows, dim_entity, dim_team, dim_period)


# ------------------------------------------------------------------ chart feeds


def _judged(pred: DataFrame) -> DataFrame:
    return pred.filter(F.col("predicted_points").isNotNull() & F.col("actual_points").isNotNull())


def feed_pred_vs_actual(pred: DataFrame) -> DataFrame:
    return _judged(pred).select("predicted_points", "actual_points")


def feed_mae_by_period(pred: DataFrame) -> DataFrame:
    gap = F.abs(F.col("actual_points") - F.col("predicted_points"))
    rows = _judged(pred).groupBy("season", "period_num").agg(F.avg(gap).alias("mae"))
    return rows.withColumn("period_label", label(F.col("season"), " R", F.col("period_num")))


def feed_residual_histogram(pred: DataFrame, bins: int = 25) -> DataFrame:
    """Equal-width bins between the extremes; the last one is closed, empty ones are listed."""
    rows = _judged(pred).select((F.col("actual_points") - F.col("predicted_points")).alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col("x") - lo, width)), F.lit(0)).cast("long")
    counts = rows.groupBy(F.least(at, F.lit(bins - 1).cast("long")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def feed_errors(pred: DataFrame, k: int = 10, worst: bool = True) -> DataFrame:
    """Largest misses, or closest hits."""
    gap = F.col("actual_points") - F.col("predicted_points")
    rows = _judged(pred).withColumns({"residual": gap, "abs_error": F.abs(gap)})
    return top_k(rows, "-abs_error" if worst else "abs_error", k, ["period_id", "entity_id"])


def feed_rating_trend(rating: DataFrame) -> DataFrame:
    """Rating by dense period index."""
    rows = dense_index(rating, [], "period_id", "period_index")
    return rows.select("entity_id", "period_id", "period_index", "rating_after")
