"""Fact builders.

Ratings are computed on the spine of results before the fact is built, so the
stages form one pass: staging, rating, fact, features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.aggregates import first_non_null
from leaguelens.operators.joins import join_normalized, star_join
from leaguelens.operators.sets import union_priority

PERIOD_COLUMNS = ["period_id", "season", "period_num", "period_name", "date_start", "is_special"]


def build_entity_fact(
    points: DataFrame,
    prices: DataFrame,
    dim_entity: DataFrame,
    dim_period: DataFrame,
    dim_team: DataFrame,
    placements: DataFrame,
    rating: DataFrame,
    seeds: DataFrame,
    team_overrides: DataFrame | None = None,
) -> DataFrame:
    """G1: one row per (period, entity) from a spine of points.

    The placement map and the team map are brought to one row per key before
    they join, so neither can multiply the spine.
    """
    who = ["period_id", "entity"]
    best = first_non_null(placements, who, "status", "finish_position")
    maps = [placements.select(*who, "team")]
    if team_overrides is not None:
        maps.append(team_overrides.select(*who, "team"))
    teams = union_priority(maps, who, "team")
    spine = points.join(dim_period.select(*PERIOD_COLUMNS), ["season", "period_num"])
    rows = star_join(
        spine,
        [
            (prices.select("season", "period_num", "entity", "price"), ["season", "period_num", "entity"]),
            (dim_entity.select(F.col("entity_name").alias("entity"), "entity_id"), "entity"),
        ],
    )
    rows = join_normalized(rows, teams, {"entity": "entity"}, "period_id")
    rows = join_normalized(
        rows, dim_team.select("season", "team_id", "team_name"), {"team": "team_name"}, "season"
    )
    rows = star_join(
        rows,
        [
            (best, who),
            (rating.select(*who, "rating_before", "rating_delta", "rating_after"), who),
            (seeds.select("period_id", "entity_id", "seed_position", "seed_laps"), ["period_id", "entity_id"]),
        ],
    )
    return rows.select(
        *PERIOD_COLUMNS,
        "entity_id",
        F.col("entity").alias("entity_name"),
        "team_id",
        "team_name",
        "price",
        "points",
        "finish_position",
        "status",
        "rating_before",
        "rating_delta",
        "rating_after",
        "seed_position",
        "seed_laps",
    )


def build_team_fact(
    points: DataFrame, prices: DataFrame, dim_period: DataFrame, dim_team: DataFrame
) -> DataFrame:
    """One row per (period, team); names match in normal form, teams per season."""
    rows = points.join(dim_period.select(*PERIOD_COLUMNS), ["season", "period_num"])
    rows = join_normalized(
        rows,
        prices.select("season", "period_num", F.col("team").alias("priced"), "price"),
        {"team": "priced"},
        ["season", "period_num"],
    )
    rows = join_normalized(
        rows, dim_team.select("season", "team_id", "team_name"), {"team": "team_name"}, "season"
    )
    return rows.select(*PERIOD_COLUMNS, "team_id", "team_name", "price", "points")
