"""Residuals, bootstrapped outcomes and scorecards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.aggregates import QUANTILES, dist_summary
from leaguelens.operators.common import GROUP_ROWS, Order, as_list, number_rows, spread
from leaguelens.operators.joins import lookup_first
from leaguelens.operators.ordering import dedupe
from leaguelens.operators.reshape import bucketize
from leaguelens.operators.sets import union_tagged
from leaguelens.plans.pools import Draws, FiledPools, blocks, draw_key, file_pools, rows_at_once

BROADCAST_ROWS = 500_000  # residuals, some 25 MB

# The two bands outcomes are drawn by and the six of the reports.
DRAW_BANDS = ([20], ["00_20", "20_plus"])
REPORT_BANDS = ([0, 5, 10, 15, 20], ["< 0", "0-5", "5-10", "10-15", "15-20", "20+"])


def prediction_bucket(bands=DRAW_BANDS, col: str = "predicted_points") -> Column:
    return bucketize(F.col(col), *bands)


def residuals(
    predictions: DataFrame, actuals: DataFrame, runs: DataFrame | None = None, bands=DRAW_BANDS
) -> DataFrame:
    """Actual minus predicted, for rows that have both."""
    rows = predictions.filter(F.col("predicted_points").isNotNull()).join(
        actuals.filter(F.col("points").isNotNull()).withColumnRenamed("points", "actual_points"),
        ["period_id", "entity_id"],
    )
    gap = F.col("actual_points") - F.col("predicted_points")
    rows = rows.withColumns(
        {"residual": gap, "abs_residual": F.abs(gap), "prediction_bucket": prediction_bucket(bands)}
    )
    return rows if runs is None else rows.join(runs, "prediction_run_id", "left")


def residual_bucket_stats(rows: DataFrame) -> DataFrame:
    """Distribution of residuals per bucket."""
    return dist_summary(rows, "prediction_bucket", "residual")


def draw_index(key: Column, sim: Column, seed: int, size: Column) -> Column:
    """A reproducible pseudo-random index below ``size``, uniform for any size a long can hold.

    Two streams of 31 bits are joined to one number. Each mixes by a cube modulo a prime,
    which is not linear: with a linear mix two entities would draw in step. ``rand``
    would depend on the partitioning.
    """
    p = 2147483647

    def cube(x: Column) -> Column:
        return x * x % p * x

    a = (cube((sim * 7919 + key * 104729 + seed * 1299709) % p) + key * 31 + sim) % p
    b = (cube((sim * 15485863 + key * 32452843 + seed * 49979687 + 1) % p) + key + sim * 17) % p
    return (a * p + b) % size


def bootstrap_outcomes(
    scores: DataFrame,
    residual_rows: DataFrame,
    n_sims: int = 10_000,
    seed: int = 42,
    tie: Order = ("period_id", "entity_id"),
    max_group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """``n_sims`` outcomes per score: the prediction plus a drawn residual of its bucket.

    Residuals are numbered per bucket and a draw names a number. Counted small, the residuals
    are broadcast and met in an equi-join on (bucket, number). More of them are sorted
    into files that the tasks read (``pools``), all or, with ``max_group_rows=0``, by pieces.
    Either way the draws stay where their score is and are never shuffled.
    """
    bucket = "prediction_bucket"
    scores = scores.filter(F.col("predicted_points").isNotNull())
    # one entry per band: the size of each pool
    sizes = {r[0]: r[1] for r in residual_rows.groupBy(bucket).count().collect()}
    asked = [r[0] for r in scores.select(bucket).distinct().collect()]
    missing = [b for b in asked if b not in sizes]
    if missing:
        raise KeyError(f"no residuals for {missing}")
    if max_group_rows == 0 or sum(sizes.values()) > BROADCAST_ROWS:
        pools = file_pools(residual_rows, sizes, 0 if max_group_rows == 0 else None)
        return _drawn_in_tasks(scores, pools, residual_rows.schema["residual"].dataType, n_sims, seed)
    pool = number_rows(
        residual_rows.select(bucket, "residual", *as_list(tie)), bucket, ["residual", *as_list(tie)], "__idx", None
    ).select(bucket, (F.col("__idx") - 1).alias("__idx"), F.col("residual").alias("sampled_residual"))
    sims = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long")))
    size = F.lit(None).cast("long")
    for name, n in sizes.items():
        size = F.when(F.col(bucket) == name, F.lit(n).cast("long")).otherwise(size)
    key = (F.col("entity_id") * 613 + F.col("period_id")) % 2147483647
    pool = F.broadcast(pool)
    # scores are few beside their draws: give every task a share before they multiply
    drawn = spread(scores, ["period_id", "entity_id"]).withColumn("simulation_id", sims)
    drawn = drawn.withColumn("__idx", draw_index(key, F.col("simulation_id"), seed, size))
    return (
        drawn.join(pool, [bucket, "__idx"])
        .withColumn("simulated_points", F.col("predicted_points") + F.col("sampled_residual"))
        .drop("__idx")
    )


def _drawn_in_tasks(scores: DataFrame, pools: FiledPools, kind: T.DataType, n_sims: int, seed: int) -> DataFrame:
    """The draws of each score as an array, made in the task that holds the score, then as rows."""
    bucket = "prediction_bucket"
    step = rows_at_once(pools, n_sims, 1 << 16)

    def run(batches):
        draws = Draws(n_sims, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                key = batch.column("__key").to_numpy()
                values = np.empty((batch.num_rows, n_sims))
                for rows, name, index in blocks(key, batch.column(bucket).to_pylist(), pools, draws, step):
                    values[rows] = pools.values(name, index)
                ends = np.arange(0, values.size + 1, n_sims, dtype=np.int32)
                drawn = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], drawn], names=[*batch.schema.names[:-1], "__drawn"])

    rest = [c for c in scores.columns if c != bucket]
    # scores are few beside their draws: give every task a share before they multiply
    rows = spread(scores, ["period_id", "entity_id"]).select(bucket, *rest, draw_key().alias("__key"))
    rows = rows.filter(F.col("__key").isNotNull())
    drawn = rows.mapInArrow(run, T.StructType([*rows.drop("__key").schema, T.StructField("__drawn", T.ArrayType(T.DoubleType()))]))
    out = drawn.select(bucket, *rest, F.posexplode("__drawn").alias("simulation_id", "sampled_residual"))
    out = out.withColumns({"simulation_id": F.col("simulation_id").cast("long"), "sampled_residual": F.col("sampled_residual").cast(kind)})
    return out.withColumn("simulated_points", F.col("predicted_points") + F.col("sampled_residual"))


OUTCOME_KEYS = ("period_id", "entity_id", "team_id", "price", "predicted_points", "prediction_bucket")


def with_risk(out: DataFrame) -> DataFrame:
    """Value and risk measures of summarised outcomes; value per price is NULL at price zero."""
    mean = F.col("mean_simulated_points")
    return out.withColumns(
        {
            "mean_per_price": F.try_divide(mean, "price"),
            "p90_per_price": F.try_divide("p90", "price"),
            "risk_range": F.col("p90") - F.col("p10"),
            "downside_gap": mean - F.col("p10"),
        }
    )


def summarize_outcomes(sims: DataFrame, keys: Sequence[str] = OUTCOME_KEYS) -> DataFrame:
    """Outcome distribution per entity with value and risk measures.

    A key has ``n_sims`` rows, so the exact quantiles fit a task, and an entity has one
    row per period, so the other keys follow from the first two.
    """
    grain, rest = list(keys)[:2], list(keys)[2:]
    return with_risk(dist_summary(sims, grain, "simulated_points", max_group_rows=None, carry=rest))


def selection_outcomes(sims: DataFrame, selection: DataFrame, profile: Order = ("profile", "period_id")):
    """A selection's points per simulation: the sum over its entities."""
    profile = as_list(profile)
    on = [c for c in selection.columns if c in sims.columns]
    members = selection.select(*{*profile, *on}).distinct()
    return (
        sims.join(members, on)
        .groupBy(*profile, "simulation_id")
        .agg(F.sum("simulated_points").alias("selection_points"))
    )


def summarize_selections(totals: DataFrame, profile: Order = ("profile", "period_id")) -> DataFrame:
    """Distribution of a selection's points."""
    return dist_summary(totals, profile, "selection_points", QUANTILES, max_group_rows=None)


def prediction_scorecard(
    entity_pred: DataFrame, team_pred: DataFrame, entity_actual: DataFrame, team_actual: DataFrame
) -> DataFrame:
    """Predictions of both asset kinds beside what happened, with the absolute error."""
    keys = ["season", "period_num", "asset_name"]
    preds = union_tagged({"team": team_pred, "entity": entity_pred}, "asset_type")
    preds = preds.withColumn("asset_name", F.upper("asset_name"))
    rows = lookup_first(preds, [entity_actual, team_actual], keys, "points")
    rows = dedupe(rows, keys, ["asset_type", "predicted_points"])
    return rows.withColumn("absolute_error", F.abs(F.col("points") - F.col("predicted_points")))


def outlier_drilldown(
    rows: DataFrame, fact: DataFrame, dim_entity: DataFrame, dim_period: DataFrame, min_abs: float
) -> DataFrame:
    """Large residuals with the result that explains them."""
    seen = fact.select("period_id", "entity_id", "position", "seed_position")
    return (
        rows.filter(F.col("abs_residual") >= min_abs)
        .join(seen, ["period_id", "entity_id"])
        .join(dim_entity.select("entity_id", "entity_name"), "entity_id")
        .join(dim_period.select("period_id", "period_name"), "period_id")
    )

