"""Pairwise rating.

Everybody in a period meets everybody else: an entity scores 1 for each
opponent it finishes ahead of and a half for each tie, and is expected to score
the sum of logistic expectations. Only those sums are needed, so no pair is
ever written out.

Sizes are looked at first. Pools that fit a task are folded in one grouped
pandas call each, periods of more than ``DIRECT_ROWS`` by the cells below. Larger ones advance period by period, each period one Spark
job over all pools, in which opponents are summarised by rating cell: within a
cell the sum of expectations is a smooth function, exact to double precision
as a Chebyshev series of degree 15 (interpolation of the kernel on both sides,
as in the black-box fast multipole method of Fong and Darve, 2009).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.aggregates import group_agg
from leaguelens.operators.common import (
    GROUP_ROWS,
    Order,
    as_list,
    attach,
    largest_group,
    running_total,
    spread,
)
from leaguelens.operators.ordering import best_row, dense_index
from leaguelens.operators.windows import forward_fill, group_max
from leaguelens.plans.rating_log import StateLog
from leaguelens.session import checkpointed, shared_folder

DIRECT_ROWS = 5_000  # entities of one period that are compared directly
PERIOD_ROWS = 500_000  # entities of one period that a task may rate
DEGREE = 16
REACH = 64  # cells; an opponent further away is a sure win or loss


@dataclass(frozen=True)
class RatingParams:
    init: float = 1500.0
    k: float = 8.0
    season_shrink: float = 0.75
    inactivity_shrink: float = 0.75
    spread: float = 400.0


def resolve_positions(
    results: DataFrame, period: Order = ("season", "period_id"), entity: str = "entity", tie: Order = ()
) -> DataFrame:
    """The position that counts for rating.

    Non-starters are left out. A blank position ranks one behind the last
    classified for a retirement, two behind for a disqualification; what is
    still blank is dropped. One row per entity, its best position.
    """
    period = as_list(period)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    rows = results.filter(~flag("dns")).withColumn(
        "position", F.col("position").cast("string").try_cast("double")
    )
    rows = group_max(rows, period, "position", "__last")
    last = F.col("__last")
    resolved = F.coalesce(
        F.col("position"),
        F.when(flag("nc") | flag("dnf"), last + 1),
        F.when(flag("dsq"), last + 2),
    )
    rows = rows.withColumn("rating_position", resolved).drop("__last")
    rows = rows.filter(F.col("rating_position").isNotNull())
    return best_row(rows, [*period, entity], ["rating_position", *as_list(tie)])


# ------------------------------------------------------------------ one period


def expected_directly(rating: np.ndarray, scale: float) -> np.ndarray:
    """Expected score of each rating against all others."""
    out = np.empty(len(rating))
    for i in range(0, len(rating), 1024):
        gap = rating[None, :] - rating[i : i + 1024, None]
        out[i : i + 1024] = (1.0 / (1.0 + np.power(10.0, gap / scale))).sum(axis=1)
    return out - 0.5


def actual_directly(position: np.ndarray) -> np.ndarray:
    """Opponents beaten plus half the ties."""
    ordered = np.sort(position)
    behind = len(position) - np.searchsorted(ordered, position, side="right")
    level = np.searchsorted(ordered, position, side="right") - np.searchsorted(ordered, position)
    return behind + 0.5 * (level - 1)


def _kernels(scale: float) -> np.ndarray:
    """Per cell offset: source cell moments to target cell coefficients."""
    width = scale / 4
    order = np.arange(DEGREE)
    node = np.cos(np.pi * (order + 0.5) / DEGREE)
    basis = np.cos(np.outer(np.arccos(node), order)) * np.where(order == 0, 1, 2) / DEGREE
    offset = np.arange(-REACH, REACH + 1)[:, None, None]
    gap = width * (offset + (node[:, None] - node[None, :]) / 2)
    kernel = 1.0 / (1.0 + np.power(10.0, -gap / scale))
    return basis.T @ kernel @ basis


def expected_in_task(rating: np.ndarray, scale: float) -> np.ndarray:
    """Expected scores within one task: directly for few ratings, else through cells as ``expected_by_cells``."""
    if len(rating) <= DIRECT_ROWS:
        return expected_directly(rating, scale)
    place = rating / (scale / 4)
    cell = np.floor(place).astype(np.int64)
    angle = np.arccos(np.clip(2 * (place - cell) - 1, -1.0, 1.0))
    cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    moments = np.stack([np.bincount(at, np.cos(angle * i), len(cells)) for i in range(DEGREE)], axis=1)
    kernels, upto = _kernels(scale), np.cumsum(n)
    low = np.searchsorted(cells, cells - REACH)
    high = np.searchsorted(cells, cells + REACH, side="right")
    coef = np.empty((len(cells), DEGREE))
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        coef[k] = np.einsum("rij,rj->i", kernels[cells[k] - cells[a:b] + REACH], moments[a:b])
    total = np.r_[0, upto][low][at] - 0.5  # those below reach are beaten for sure
    for i in range(DEGREE):
        total += coef[at, i] * np.cos(angle * i)
    return total


def expected_by_cells(
    df: DataFrame, group: Order, rating: str, name: str, params: RatingParams
) -> DataFrame:
    """Expected scores for groups too large to compare directly.

    Each cell is reduced to ``DEGREE`` moments on the map side; a cell meets
    the cells within ``REACH``, and all lower ones by their count.
    """
    group = as_list(group)
    place = (F.col(rating) - params.init) / (params.spread / 4)
    cell = F.floor(place).cast("long")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (place - cell) - 1)))
    rows = df.withColumns({"__cell": cell, "__angle": angle})
    moments = rows.groupBy(*group, "__cell").agg(
        F.count(F.lit(1)).alias("__n"),
        F.array(*[F.sum(F.cos(F.col("__angle") * i)) for i in range(DEGREE)]).alias("__m"),
    )
    moments = checkpointed(moments)  # small beside the rows, read three times
    counted = running_total(moments, group, "__cell", F.col("__n"), "__upto")
    kernels = _kernels(params.spread)

    @F.pandas_udf("array<double>")
    def shifted(offset: pd.Series, moment: pd.Series) -> pd.Series:
        m = np.stack(moment.to_numpy())
        out = np.einsum("rij,rj->ri", kernels[offset.to_numpy() + REACH], m)
        return pd.Series(list(out))

    reach = F.sequence(F.lit(-REACH), F.lit(REACH))
    sent = (
        moments.withColumn("__offset", F.explode(reach))
        .withColumn("__target", F.col("__cell") + F.col("__offset"))
        .select(*group, F.col("__target").alias("__cell"), "__offset", "__n", "__m")
    )
    sent = sent.join(moments.select(*group, "__cell"), [*group, "__cell"], "left_semi")
    sent = sent.withColumn("__b", shifted("__offset", "__m"))
    near = sent.groupBy(*group, "__cell").agg(
        F.sum(F.when(F.col("__offset") >= 0, F.col("__n"))).alias("__near"),
        *[F.sum(F.col("__b")[i]).alias(f"__b{i}") for i in range(DEGREE)],
    )
    coef = attach(near, counted.select(*group, "__cell", "__upto"), [*group, "__cell"])
    series = sum((F.col(f"__b{i}") * F.cos(F.col("__angle") * i) for i in range(DEGREE)), F.lit(0.0))
    total = series + F.col("__upto") - F.col("__near") - 0.5
    joined = attach(rows, coef, [*group, "__cell"]).withColumn(name, total)
    return joined.drop(
        "__cell", "__angle", "__near", "__upto", *[f"__b{i}" for i in range(DEGREE)]
    )


def actual_by_counts(df: DataFrame, group: Order, position: str, name: str) -> DataFrame:
    """Actual scores from the number of entities at each position."""
    group = as_list(group)
    level = group_agg(df, [*group, position], {"__level": F.count(F.lit(1))})
    level = running_total(level, group, f"-{position}", F.col("__level"), "__upto")
    score = F.col("__upto") - F.col("__level") + 0.5 * (F.col("__level") - 1)
    return attach(df, level, [*group, position]).withColumn(name, score).drop("__level", "__upto")


def matchup_totals(
    df: DataFrame,
    group: Order,
    entity: str,
    position: str = "rating_position",
    rating: str = "rating_before",
    params: RatingParams = RatingParams(),
    period_rows: int = PERIOD_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Expected and actual score of each entity against its whole group, and the change.

    ``largest`` is the size of the largest group, if it is known already.
    """
    group = as_list(group)
    if (largest_group(df, group) if largest is None else largest) > period_rows:
        df = checkpointed(df)  # every pass below starts from the written rows
        out = actual_by_counts(df, group, position, "actual")
        out = expected_by_cells(out, group, rating, "expected", params)
    else:
        scale = params.spread

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(
                actual=actual_directly(pdf[position].to_numpy(float)),
                expected=expected_in_task(pdf[rating].to_numpy(float), scale),
            )

        schema = df.withColumns({"actual": F.lit(0.0), "expected": F.lit(0.0)}).schema
        out = spread(df, group).groupBy(*group).applyInPandas(score, schema)
    return out.withColumn("rating_delta", params.k * (F.col("actual") - F.col("expected")))


def rating_step(
    state: DataFrame,
    results: DataFrame,
    pool: Order,
    entity: str,
    params: RatingParams = RatingParams(),
    period_rows: int = PERIOD_ROWS,
    clock: DataFrame | None = None,
) -> DataFrame:
    """Rate one period per pool against the state before it.

    ``state`` holds pool, entity, rating, last_season and changes, the number
    of season changes its pool had seen by then. A season change shrinks all
    known ratings; that is applied here when an entity returns. ``clock`` has the
    newest last_season and changes of each pool where ``state`` holds some entities only.
    """
    pool = as_list(pool)
    clock = (state if clock is None else clock).groupBy(*pool).agg(
        F.max("last_season").alias("__prev"), F.max("changes").alias("__changes")
    )
    rows = attach(results, clock, pool)
    # merged, not broadcast: a state sent through the driver once a period adds up
    rows = attach(rows, state.hint("merge"), [*pool, entity])
    now = F.coalesce("__changes", F.lit(0)) + F.coalesce(
        (F.col("season") != F.col("__prev")).cast("int"), F.lit(0)
    )
    absent = F.greatest(F.lit(0), F.col("season") - F.col("last_season") - 1)
    shrink = F.pow(F.lit(params.season_shrink), now - F.col("changes")) * F.pow(
        F.lit(params.inactivity_shrink), absent
    )
    before = F.coalesce(params.init + shrink * (F.col("rating") - params.init), F.lit(params.init))
    rows = rows.withColumns({"rating_before": before, "changes": now.cast("int")}).drop(
        "__prev", "__changes", "rating", "last_season"
    )
    group = [*pool, "season", "period_id"]
    largest = largest_group(results, group)  # of the bare results: no join is run for it
    rated = matchup_totals(rows, group, entity, params=params, period_rows=period_rows, largest=largest)
    return rated.withColumn("rating_after", F.col("rating_before") + F.col("rating_delta"))


def next_state(state: DataFrame, rated: DataFrame, pool: Order, entity: str) -> DataFrame:
    """State after a rated period."""
    keys = [*as_list(pool), entity]
    fresh = rated.select(
        *keys, F.col("rating_after").alias("rating"), F.col("season").alias("last_season"), "changes"
    )
    return state.join(fresh, keys, "left_anti").unionByName(fresh)


def empty_state(results: DataFrame, pool: Order, entity: str) -> DataFrame:
    keys = [*as_list(pool), entity]
    return results.limit(0).select(
        *keys,
        F.lit(0.0).alias("rating"),
        F.col("season").alias("last_season"),
        F.lit(0).alias("changes"),
    )


# ------------------------------------------------------------------ all periods

RATING_COLUMNS = ["rating_before", "rating_delta", "rating_after"]


def _fold(entity: str, params: RatingParams):
    """All periods of one pool in order; ratings live in arrays indexed by entity."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["season", "period_id", "rating_position", entity], ignore_index=True)
        who, names = pd.factorize(pdf[entity])
        season = pdf["season"].to_numpy(int)
        position = pdf["rating_position"].to_numpy(float)
        rating = np.full(len(names), params.init)
        last = np.full(len(names), np.iinfo(np.int64).max)
        seen = np.zeros(len(names), dtype=int)
        before, delta = np.empty(len(pdf)), np.empty(len(pdf))
        starts = np.flatnonzero(
            np.r_[True, (np.diff(season) != 0) | (pdf["period_id"].to_numpy()[1:] != pdf["period_id"].to_numpy()[:-1])]
        )
        changes = 0
        for a, b in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            if a and season[a] != season[a - 1]:
                changes += 1
            ids = who[a:b]
            if len(np.unique(ids)) != len(ids):
                raise ValueError(f"repeated {entity} in period {pdf['period_id'].iloc[a]}")
            absent = np.maximum(0, season[a] - last[ids] - 1)
            shrink = params.season_shrink ** (changes - seen[ids]) * params.inactivity_shrink**absent
            now = params.init + shrink * (rating[ids] - params.init)
            move = params.k * (actual_directly(position[a:b]) - expected_in_task(now, params.spread))
            before[a:b], delta[a:b] = now, move
            rating[ids], last[ids], seen[ids] = now + move, season[a], changes
        return pdf.assign(rating_before=before, rating_delta=delta, rating_after=before + delta)

    return fold


def _by_period(rows: DataFrame, pool: list[str], entity: str, params, period_rows) -> DataFrame:
    """One Spark job per period; every step is a written table, so a lost executor costs one step.

    The state is a log of what each period changed, see ``rating_log``.
    """
    spark = rows.sparkSession
    home = shared_folder(spark, "rating")
    steps = dense_index(rows, [], "__order", "__step").drop("__order")
    steps.write.partitionBy("__step").parquet(f"{home}/results")
    results = spark.read.parquet(f"{home}/results")
    last = results.agg(F.max("__step")).first()[0] or 0
    schema = rows.drop("__order").schema
    log = StateLog(spark, f"{home}/state", empty_state(rows, pool, entity).schema, pool, entity)
    for step in range(1, last + 1):
        one = spark.read.schema(schema).parquet(f"{home}/results/__step={step}")
        if one.groupBy(*pool, "season", "period_id", entity).count().filter("count > 1").limit(1).count():
            raise ValueError(f"repeated {entity} in a period")
        rated = rating_step(log.latest(one), one, pool, entity, params, period_rows, log.clock())
        rated.write.parquet(f"{home}/rated/__step={step}")
        log.add(spark.read.schema(rated.schema).parquet(f"{home}/rated/__step={step}"))
    return spark.read.parquet(f"{home}/rated").select(*[f.name for f in schema], *RATING_COLUMNS)


def sequential_rating(
    results: DataFrame,
    pool: Order = (),
    entity: str = "entity",
    params: RatingParams = RatingParams(),
    pool_rows: int = GROUP_ROWS,
    period_rows: int = PERIOD_ROWS,
) -> DataFrame:
    """Ratings before and after every period, in (season, period) order.

    ``results`` has season, period_id, ``entity`` and rating_position. Pools
    are independent; without ``pool`` everybody is in one.
    """
    pool = as_list(pool)
    rows = results.filter(F.col("rating_position").isNotNull() & F.col(entity).isNotNull())
    if not pool:
        rows = rows.withColumn("__pool", F.lit(0))
    keys = pool or ["__pool"]
    small = (
        largest_group(rows, keys) <= pool_rows
        and largest_group(rows, [*keys, "season", "period_id"]) <= period_rows
    )
    if small:
        schema = rows.withColumns({c: F.lit(0.0) for c in RATING_COLUMNS}).schema
        out = spread(rows, keys).groupBy(*keys).applyInPandas(_fold(entity, params), schema)
    else:
        order = F.struct("season", "period_id")
        out = _by_period(rows.withColumn("__order", order), keys, entity, params, period_rows)
    return out if pool else out.drop("__pool")


def expand_rating(
    rating: DataFrame, spine: DataFrame, keys: Order = ("period_id", "entity_id"), init: float = 1500.0
) -> DataFrame:
    """A rating for every spine row; without a result the last one is carried."""
    keys = as_list(keys)
    rows = spine.join(rating.select(*keys, *RATING_COLUMNS), keys, "left")
    # one row per (entity, period) bounds the window
    rows = forward_fill(rows, keys[1], keys[0], "rating_after", name="__carried", max_group_rows=None)
    before = F.coalesce("rating_before", "__carried", F.lit(init))
    return rows.withColumns(
        {
            "rating_after": F.coalesce(F.col("rating_after"), before),
            "rating_before": before,
            "rating_delta": F.coalesce("rating_delta", F.lit(0.0)),
        }
    ).drop("__carried")

