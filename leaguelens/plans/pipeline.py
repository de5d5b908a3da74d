"""The whole run: staged tables to rating, facts, features and reports.

Every stage is a written table under ``home``: the next stage starts from a
scan, lineage stays one stage long, and a failed run can resume from what it has.
Ratings come from the results alone and are expanded onto the spine of points,
so nothing has to be built twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import Order
from leaguelens.operators.ordering import best_row
from leaguelens.operators.quality import raise_if_any, run_suite
from leaguelens.plans.facts import build_entity_fact, build_team_fact
from leaguelens.plans.features import (
    entity_features,
    scoring_frame_entity,
    scoring_frame_team,
    team_features,
)
from leaguelens.plans.rating import (
    RatingParams,
    expand_rating,
    resolve_positions,
    sequential_rating,
)
from leaguelens.sources.tables import is_complete, new_rows, overwrite_table, read_or_empty

# The declared grain and content of all tables.
_FEATURES = ["period_id", "season", "entity_id", "team_id", "price", "rating_before", "seed_last_5_avg", "seed_vs_partner_last_5"]
_SEEDS = {"seed_last_5_avg": (1, 25), "seed_vs_partner_last_5": (-25, 25)}


def _rules(columns: list[str], grain: list[str], not_null: list[str] | None = None, **more) -> dict:
    return {"columns": columns, "not_null": columns if not_null is None else not_null, "grain": grain, **more}


SUITE = {
    "dim_entity": _rules(["entity_id", "entity_name", "acronym"], ["entity_id"]),
    "dim_team": _rules(["team_id", "season", "team_name"], ["season", "team_id"]),
    "dim_period": _rules(["period_id", "season", "period_num", "period_name"], ["period_id"]),
    "entity_fact": _rules(
        ["period_id", "season", "entity_id", "team_id", "price", "points", "rating_before"],
        ["period_id", "entity_id"],
        filled=(["season", "period_id"], "seed_position"),
    ),
    "team_fact": _rules(["period_id", "season", "team_id", "price", "points"], ["period_id", "team_id"]),
    "entity_features": _rules(_FEATURES, ["period_id", "entity_id"], range=_SEEDS),
    "team_features": _rules(["period_id", "season", "team_id", "price"], ["period_id", "team_id"]),
    "entity_frame": _rules(_FEATURES, ["period_id", "entity_id"]),
    "team_frame": _rules(["period_id", "season", "team_id", "price"], ["period_id", "team_id"]),
    "prediction_run": _rules(
        [
            "prediction_run_id", "created_at", "model_name", "model_version", "feature_set_version", "target",
            "train_cutoff_period_id", "asset_type",
        ],
        ["prediction_run_id"],
    ),
    "entity_predictions": _rules(
        ["prediction_run_id", "season", "period_id", "entity_id", "team_id", "price", "predicted_points"],
        ["prediction_run_id", "period_id", "entity_id"],
    ),
    "team_predictions": _rules(
        ["prediction_run_id", "season", "period_id", "team_id", "price", "predicted_points"],
        ["prediction_run_id", "period_id", "team_id"],
    ),
    "seeds": _rules(
        ["period_id", "entity_id", "seed_position", "seed_laps"],
        ["period_id", "entity_id"],
        ["period_id", "entity_id"],
        range={"seed_position": (1, 25)},
        coverage=(["period_id"], "entity_id", 18),
        resolved=["period_id", "entity_id"],
    ),
}


class Stages:
    """Tables of one run, written once and read back; with ``resume``, those a failed run completed stay."""

    def __init__(self, spark, home: str, resume: bool = False):
        self.spark, self.home, self.resume, self.tables = spark, home, resume, {}

    def write(self, name: str, df: DataFrame, partition_by: Order = None) -> DataFrame:
        path = f"{self.home}/{name}"
        if not (self.resume and is_complete(self.spark, path)):
            self.resume = False  # what follows was made from what is made anew
            overwrite_table(df, path, partition_by)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]


def rate(placements: DataFrame, params: RatingParams) -> DataFrame:
    """Ratings of all results, one pool."""
    results = placements.withColumnRenamed("finish_position", "position")
    resolved = resolve_positions(results, ["season", "period_id"])
    rows = resolved.select("season", "period_id", "entity", "rating_position")
    return sequential_rating(rows, params=params)


def run(
    spark,
    staged: dict[str, DataFrame],
    home: str,
    params: RatingParams = RatingParams(),
    checks: dict | None = None,
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Build everything downstream of staging; ``resume`` goes on from the tables a failed run completed.

    ``staged`` has entity_points, entity_prices, team_points, team_prices,
    placements, seeds, dim_entity, dim_team, dim_period and, if needed,
    team_overrides. Raises when a check of ``checks`` finds something.
    """
    out = Stages(spark, home, resume)
    points, prices = staged["entity_points"], staged["entity_prices"]
    rating = out.write("rating", rate(staged["placements"], params))
    periods = staged["dim_period"].select("season", "period_num", "period_id")
    spine = points.join(periods, ["season", "period_num"]).select("period_id", "entity")
    rating = out.write("staged_rating", expand_rating(rating, spine, ["period_id", "entity"], params.init))
    fact = out.write(
        "entity_fact",
        build_entity_fact(
            points,
            prices,
            staged["dim_entity"],
            staged["dim_period"],
            staged["dim_team"],
            staged["placements"],
            rating,
            staged["seeds"],
            staged.get("team_overrides"),
        ),
    )
    teams = out.write(
        "team_fact",
        build_team_fact(staged["team_points"], staged["team_prices"], staged["dim_period"], staged["dim_team"]),
    )
    out.write("entity_features", entity_features(fact, "date_start"))
    out.write("team_features", team_features(teams, order="date_start"))
    known = {**{k: staged[k] for k in ("dim_entity", "dim_team", "dim_period", "seeds")}, **out.tables}
    if checks is None:
        checks = {k: v for k, v in SUITE.items() if k in known}
    raise_if_any(run_suite(known, checks), "checks failed")
    return out.tables


# The key by which a staged row is known from one refresh to the next.
STAGED_KEYS = {
    "entity_points": ["season", "period_num", "entity"],
    "entity_prices": ["season", "period_num", "entity"],
    "team_points": ["season", "period_num", "team"],
    "team_prices": ["season", "period_num", "team"],
    "placements": ["period_id", "entity"],
    "seeds": ["period_id", "entity_id"],
    "dim_entity": ["entity_id"],
    "dim_team": ["season", "team_id"],
    "dim_period": ["period_id"],
    "team_overrides": ["period_id", "entity"],
}


def refresh(
    spark, staged: dict[str, DataFrame], home: str, params: RatingParams = RatingParams(), checks: dict | None = None
) -> dict[str, DataFrame]:
    """Add what ``staged`` brings to what earlier refreshes staged, and build from all of it.

    Rows whose key is staged already are left out, so a repeated or overlapping delivery
    changes nothing; tables built from the staged ones are built anew.
    """
    held = {}
    for name, df in staged.items():
        path = f"{home}/staged/{name}"
        before = read_or_empty(spark, path, df.schema)
        new_rows(df, before, STAGED_KEYS[name]).write.mode("append").parquet(path)
        held[name] = spark.read.schema(df.schema).parquet(path)
    return run(spark, held, f"{home}/built", params, checks)


def score_frames(staged: dict[str, DataFrame], built: dict[str, DataFrame], season: int, num: int):
    """(entity, team) scoring frames of one upcoming period, NULL targets."""
    target = staged["dim_period"].filter((F.col("season") == season) & (F.col("period_num") == num))
    entity = scoring_frame_entity(
        target, staged["entity_prices"], staged["dim_entity"], built["entity_features"], built["entity_fact"]
    )
    team = scoring_frame_team(target, staged["team_prices"], staged["dim_team"], built["team_features"])
    return entity, team


def latest_ratings(built: dict[str, DataFrame]) -> DataFrame:
    """Current rating per entity."""
    rows = built["entity_fact"].select("entity_id", "period_id", "rating_after")
    return best_row(rows, "entity_id", "-period_id")
