"""Staging jobs: raw landings to conformed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.scalars import element, normalize_key, parse_ts_utc, prefix_int
from leaguelens.operators.joins import join_normalized
from leaguelens.operators.keys import flag_members
from leaguelens.operators.ordering import dedupe
from leaguelens.operators.reshape import (
    canonicalize,
    drop_nulls,
    project,
    status_flags,
    where_like,
)

# Result texts and names as the result sources write them.
STATUS_GROUPS = {
    "dnf": ["Retired", "Accident", "Collision damage", "Undertray"],
    "dns": ["Did not start", "Withdrew"],
    "dsq": ["Disqualified"],
}
NAME_ALIASES = {
    "guanyu zhou": "zhou guanyu",
    "andrea kimi antonelli": "kimi antonelli",
}
CANCELLED = "called off|test"
SPECIAL = "sprint"


def stage_placements(
    raw: DataFrame, aliases: dict[str, str] | None = None, null_position_as_zero: bool = False
) -> DataFrame:
    """One row per result, canonical names, status flags.

    A blank position stays NULL so that ``resolve_positions`` can rank it
    behind the classified; ``null_position_as_zero`` turns it into 0.
    """
    keys = ["period_id", "meeting_key", "session_key", "season", "period_name", "full_name"]
    rows = dedupe(raw, keys, ["position", "status", "team_name"])
    rows = rows.withColumns({"entity": F.col("full_name"), "team": normalize_key(F.col("team_name"))})
    rows = canonicalize(rows, "entity", NAME_ALIASES if aliases is None else aliases)
    rows = status_flags(rows, "status", STATUS_GROUPS).withColumn("nc", F.lit(0))
    rows = rows.withColumnsRenamed({"position": "finish_position"})
    if null_position_as_zero:
        rows = rows.na.fill(0.0, ["finish_position", "grid_position"])
    return rows.select(
        "period_id",
        "season",
        "period_name",
        "entity",
        "team",
        "finish_position",
        "classified_position",
        "status",
        "grid_position",
        "dns",
        "dnf",
        "dsq",
        "nc",
    )


def stage_qualifying(
    raw: DataFrame,
    sessions: DataFrame,
    session_entities: DataFrame,
    dim_period: DataFrame,
    dim_entity: DataFrame,
) -> DataFrame:
    """Seed results with their period and entity resolved, segment times split.

    Only sessions of type ``Qualifying`` count. The number-to-name map is made
    unique before it joins, because numbers repeat in every session.
    """
    wanted = sessions.filter(F.col("session_type") == "Qualifying").select("session_key").distinct()
    numbers = session_entities.select("meeting_key", "entity_number", "full_name").distinct()
    periods = dim_period.select("meeting_key", "season", "period_id")
    rows = raw.join(wanted, "session_key", "left_semi")
    rows = rows.join(periods, "meeting_key", "left").join(
        numbers, ["meeting_key", "entity_number"], "left"
    )
    rows = join_normalized(rows, dim_entity.select("entity_id", "entity_name"), {"full_name": "entity_name"})
    return rows.select(
        "season",
        "period_id",
        "meeting_key",
        "session_key",
        "entity_number",
        F.col("full_name").alias("entity_name"),
        "entity_id",
        F.col("position").alias("seed_position"),
        F.col("number_of_laps").alias("seed_laps"),
        *[element(F.col("duration"), i).alias(f"q{i + 1}_time") for i in range(3)],
        "dnf",
        "dns",
        "dsq",
    )


def stage_meetings(raw: DataFrame) -> DataFrame:
    """One row per meeting that took place, times parsed."""
    rows = dedupe(raw, "meeting_key", ["date_start", "meeting_name"])
    rows = where_like(rows, "meeting_official_name", CANCELLED, negate=True)
    rows = project(
        rows,
        ["meeting_key", "meeting_name", "country_name", "venue", "venue_type", "date_start", "date_end", "season"],
    )
    return rows.withColumns({c: parse_ts_utc(F.col(c)) for c in ("date_start", "date_end")})


def stage_sessions(raw: DataFrame) -> DataFrame:
    """One row per session, times parsed."""
    rows = project(
        dedupe(raw, "session_key", ["date_start", "session_name"]),
        ["session_key", "session_type", "session_name", "date_start", "date_end", "meeting_key", "location", "season"],
    )
    return rows.withColumns({c: parse_ts_utc(F.col(c)) for c in ("date_start", "date_end")})


def stage_entities(raw: DataFrame) -> DataFrame:
    """One row per entity and session, names in lower case."""
    rows = dedupe(raw, ["meeting_key", "session_key", "full_name"], ["entity_number", "acronym"])
    rows = project(
        rows,
        ["meeting_key", "session_key", "entity_number", "full_name", "acronym", "team_name"],
    )
    return rows.withColumn("full_name", F.lower("full_name"))


def stage_teams(raw: DataFrame) -> DataFrame:
    """One row per team and season."""
    return raw.select("season", "team_name").distinct()


def stage_long_measures(long: DataFrame) -> DataFrame:
    """Long sheet rows without gaps, the season taken from the sheet's name."""
    rows = drop_nulls(long).withColumn("season", prefix_int(F.col("source_sheet"), 4))
    return rows.drop("source_sheet")


def build_dim_period(meetings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Periods with a special-weekend flag; ids come from ``assign_keys``."""
    special = where_like(sessions, "session_name", SPECIAL).select("meeting_key")
    return flag_members(meetings, "meeting_key", special, "is_special")
