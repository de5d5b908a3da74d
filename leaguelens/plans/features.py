"""Leakage-safe features and scoring frames.

Windows run over a fact with one row per (entity, period), so a key holds at
most as many rows as there are periods. Peer statistics are aggregates joined
back, because a team or pool has no such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import Order, as_list
from leaguelens.operators.joins import join_normalized
from leaguelens.operators.reshape import sign_flags
from leaguelens.operators.windows import (
    latest_per_key,
    rest_of_group_sum,
    vs_partner,
    windowed,
)

ENTITY_FEATURES = [
    "price_change",
    "price_change_pct",
    "points_last_5_avg",
    "ppm_last_5",
    "seed_last_5_avg",
    "seed_vs_partner_last_5",
    "price_increase",
    "price_decrease",
    "momentum",
    "partner_points_last_5",
    "partner_delta_last_5",
]
TEAM_FEATURES = [
    "price_change",
    "price_change_pct",
    "points_last_5_avg",
    "points_last_3_avg",
    "ppm_last_5",
    "ppm_last_3",
    "momentum",
    "price_increase",
    "price_decrease",
]
DEFAULT_SEED = 20  # assumed seed average of an entity without history


def _trailing(w, col: str, n: int) -> Column:
    return F.avg(col).over(w.rowsBetween(-n, -1))


def _entity_columns(w) -> dict[str, Column]:
    prev = F.lag("price").over(w)
    return {
        "__change": F.col("price") - prev,
        "__change_pct": F.try_divide(F.col("price") - prev, prev),
        "__p5": _trailing(w, "points", 5),
        "__p3": _trailing(w, "points", 3),
        "__seed": _trailing(w, "seed_position", 5),
        "__gap5": _trailing(w, "__gap", 5),
    }


PEERS = ["season", "period_id", "team_id"]


def _with_gap(fact: DataFrame) -> DataFrame:
    return vs_partner(fact, PEERS, "seed_position", "__gap")


def _entity_rows(rows: DataFrame) -> DataFrame:
    """Features of rows whose windows are evaluated."""
    rows = rest_of_group_sum(rows, PEERS, "__p5", "__rest")
    rows = sign_flags(rows, "__change", "price_increase", "price_decrease")
    fill = lambda c, v=0.0: F.coalesce(c, F.lit(v))
    feats = {
        "price_change": fill(F.col("__change")),
        "price_change_pct": fill(F.col("__change_pct")),
        "points_last_5_avg": fill(F.col("__p5")),
        "ppm_last_5": fill(F.try_divide(F.col("__p5"), F.col("price"))),
        "seed_last_5_avg": fill(F.col("__seed"), float(DEFAULT_SEED)),
        "seed_vs_partner_last_5": fill(F.col("__gap5")),
        "momentum": fill(F.col("__p3") - F.col("__p5")),
        "partner_points_last_5": fill(F.col("__rest")),
        # the difference uses the undefaulted peer sum
        "partner_delta_last_5": fill(F.col("__p5") - F.col("__rest")),
    }
    return rows.select(
        "season",
        "period_id",
        "date_start",
        F.col("is_special").cast("int").alias("is_special"),
        "entity_id",
        "team_id",
        "price",
        "points",
        "rating_before",
        *[feats[c].alias(c) if c in feats else c for c in ENTITY_FEATURES],
    )


def entity_features(fact: DataFrame, order: Order = "period_id") -> DataFrame:
    """Rolling and peer-relative features; every window stops before the row's own period."""
    return _entity_rows(windowed(_with_gap(fact), "entity_id", order, _entity_columns, max_group_rows=None))


def _team_columns(w) -> dict[str, Column]:
    prev = F.lag("price").over(w)
    return {
        "price_change": F.col("price") - prev,
        "price_change_pct": F.try_divide(F.col("price") - prev, prev),
        **{f"points_last_{n}_avg": _trailing(w, "points", n) for n in (5, 3)},
    }


def _team_rows(rows: DataFrame) -> DataFrame:
    rows = sign_flags(rows, "price_change", "price_increase", "price_decrease")
    rows = rows.withColumns(
        {
            "ppm_last_5": F.try_divide("points_last_5_avg", "price"),
            "ppm_last_3": F.try_divide("points_last_3_avg", "price"),
            "momentum": F.col("points_last_3_avg") - F.col("points_last_5_avg"),
            "is_special": F.col("is_special").cast("int"),
        }
    )
    head = ["season", "period_id", "date_start", "is_special", "team_id", "price", "points"]
    return rows.select(*head, *TEAM_FEATURES)


def team_features(fact: DataFrame, key: str = "team_name", order: Order = "period_id") -> DataFrame:
    """Team features, NULL where history is missing.

    ``key`` is the name by default: team ids change with the season.
    """
    return _team_rows(windowed(fact, key, order, _team_columns, max_group_rows=None))


def scoring_frame_entity(
    target: DataFrame,
    prices: DataFrame,
    dim_entity: DataFrame,
    history: DataFrame,
    fact: DataFrame,
) -> DataFrame:
    """One row per priced entity of the target period(s), target NULL.

    Features are the entity's latest historical ones, one period old by
    design; the special flag is carried along with them.
    """
    latest = latest_per_key(history, "entity_id", "period_id").select(
        "entity_id", "team_id", "is_special", *ENTITY_FEATURES
    )
    rating = latest_per_key(fact.select("entity_id", "period_id", "rating_after"), "entity_id", "period_id")
    rows = (
        target.select("season", "period_num", "period_id", "date_start")
        .join(prices.select("season", "period_num", "entity", "price"), ["season", "period_num"])
        .join(dim_entity.select(F.col("entity_name").alias("entity"), "entity_id"), "entity")
        .join(latest, "entity_id", "left")
        .join(rating.select("entity_id", F.col("rating_after").alias("rating_before")), "entity_id", "left")
    )
    return rows.select(
        "season",
        "period_id",
        "date_start",
        "is_special",
        "entity_id",
        "team_id",
        "price",
        F.lit(None).cast("double").alias("points"),
        "rating_before",
        *ENTITY_FEATURES,
    )


def scoring_frame_team(
    target: DataFrame, prices: DataFrame, dim_team: DataFrame, history: DataFrame
) -> DataFrame:
    """As G5 for teams; the special flag is the target period's own."""
    latest = latest_per_key(history, "team_id", "period_id").select("team_id", *TEAM_FEATURES)
    rows = target.select("season", "period_num", "period_id", "date_start", "is_special").join(
        prices.select("season", "period_num", "team", "price"), ["season", "period_num"]
    )
    rows = join_normalized(
        rows, dim_team.select("season", "team_id", "team_name"), {"team": "team_name"}, "season", "inner"
    ).join(latest, "team_id", "left")
    return rows.select(
        "season",
        "period_id",
        "date_start",
        F.col("is_special").cast("int").alias("is_special"),
        "team_id",
        "price",
        F.lit(None).cast("double").alias("points"),
        *TEAM_FEATURES,
    )


# The price rules the study of price moves works with.
PRICE_TIER, PRICE_CEILING, PRICE_FLOOR = 18.5, 34.0, 3.0


def price_dynamics(fact: DataFrame, order: Order = "period_id") -> DataFrame:
    """Price moves against recent form, for rows with a next price and full history."""

    def cols(w):
        frame = w.rowsBetween(-3, -1)
        return {
            "prev_price": F.lag("price").over(w),
            "next_price": F.lead("price").over(w),
            "form_count": F.count("points").over(frame),
            "form_avg": F.avg("points").over(frame),
        }

    p = F.col("price")
    rows = windowed(fact, "entity_id", order, cols, max_group_rows=None)
    rows = rows.filter(F.col("next_price").isNotNull() & (F.col("form_count") == 3))
    two = lambda c: F.round(c, 2)
    return rows.select(
        "season",
        "period_id",
        "entity_id",
        "team_id",
        two(p).alias("price"),
        two(F.col("prev_price")).alias("prev_price"),
        two(F.col("next_price")).alias("next_price"),
        two(F.col("next_price") - p).alias("next_price_delta"),
        two(F.col("points")).alias("points"),
        "form_count",
        two(F.col("form_avg")).alias("form_avg"),
        F.when(p < PRICE_TIER, "below_18_5").otherwise("above_18_5").alias("price_tier"),
        two(PRICE_CEILING - p).alias("distance_from_ceiling"),
        two(p - PRICE_FLOOR).alias("distance_from_floor"),
        F.when(p >= PRICE_CEILING, 1).otherwise(0).alias("at_price_ceiling"),
        F.when(p <= PRICE_FLOOR, 1).otherwise(0).alias("at_price_floor"),
    )


def history_before(df: DataFrame, season: int, num: int) -> DataFrame:
    """Rows before a period, seasons first."""
    s, n = F.col("season"), F.col("period_num")
    return df.filter((s < season) | ((s == season) & (n < num)))


def feature_columns(df: DataFrame, drop: Order = ("points",)) -> list[str]:
    return [c for c in df.columns if c not in as_list(drop)]
