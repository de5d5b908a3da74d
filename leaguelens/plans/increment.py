"""A season's tables kept up to date by deliveries, from staging to features, without building anew.

A delivery brings raw rows under natural keys: names, seasons, dates. Unseen entities, teams and
periods get ids that go on from the highest; known rows are left out by the index of their keys;
facts, ratings and features are computed for the arriving periods from the arrivals and a small
state. Nothing reads the rows of earlier periods. A delivery is a numbered step: what it brings is
written first, so that a step that failed is finished by the next call before anything else.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.keys import number_within_season
from leaguelens.operators.quality import raise_if_any, run_suite
from leaguelens.plans import feature_state as fs
from leaguelens.plans.facts import build_entity_fact, build_team_fact
from leaguelens.plans.rating import RatingParams, empty_state, expand_rating, next_state, rating_step, resolve_positions, sequential_rating
from leaguelens.sources.key_index import KeyIndex
from leaguelens.sources.tables import is_complete, overwrite_table, read_or_empty

_GRAIN = ["season", "period_num"]
# Natural keys of what a delivery may bring.
DELIVERED = {
    "meetings": ["season", "date_start"],
    "entity_points": [*_GRAIN, "entity"],
    "entity_prices": [*_GRAIN, "entity"],
    "team_points": [*_GRAIN, "team"],
    "team_prices": [*_GRAIN, "team"],
    "placements": [*_GRAIN, "entity"],
    "seeds": [*_GRAIN, "entity"],
}
DIM_ENTITY = "entity_id long, entity_name string"
DIM_TEAM = "team_id long, season int, team_name string"
DIM_PERIOD = "period_id long, season int, period_num long, period_name string, date_start timestamp_ntz, is_special boolean"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass
class Store:
    """The tables under ``home``: ``staged`` and ``dim_*`` grow, ``built`` has one folder per step."""

    spark: SparkSession
    home: str
    params: RatingParams = RatingParams()

    def __post_init__(self):
        self.entities = fs.FeatureState(self.spark, f"{self.home}/state/entity", fs.ENTITY, "date_start")
        self.teams = fs.FeatureState(self.spark, f"{self.home}/state/team", fs.TEAM_BY_NAME, "date_start")

    # ---- reading

    def steps(self) -> list[int]:
        """The finished steps."""
        try:
            return sorted(r["step"] for r in self.spark.read.parquet(f"{self.home}/done").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def dim(self, name: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.home}/dim_{name}", _schema({"entity": DIM_ENTITY, "team": DIM_TEAM, "period": DIM_PERIOD}[name]))

    def built(self, name: str, steps: list[int] | None = None) -> DataFrame:
        """A built table, of all finished steps or of some: entity_fact, team_fact, rating."""
        paths = [f"{self.home}/built/{name}/at_{s}" for s in (self.steps() if steps is None else steps)]
        return self.spark.read.parquet(*paths)

    def staged(self, name: str, schema: T.StructType) -> DataFrame:
        return read_or_empty(self.spark, f"{self.home}/staged/{name}", schema)

    # ---- writing

    def _write(self, df: DataFrame, name: str, step: int) -> DataFrame:
        path = f"{self.home}/built/{name}/at_{step}"
        overwrite_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deliver(self, raw: dict[str, DataFrame], checks: dict | None = None) -> int:
        """Take in a delivery and return the number of its step, or of the last one if it brings nothing new.

        Rows whose key is staged already are left out, also if they differ: a correction needs a
        new store. Points of a period that is not later than all built ones raise, before anything
        is stored. A period arrives whole; its prices may come before.
        """
        unknown = set(raw) - set(DELIVERED)
        if unknown:
            raise KeyError(f"not deliverable: {sorted(unknown)}")
        done = self.steps()
        step = done[-1] + 1 if done else 0
        if is_complete(self.spark, f"{self.home}/arrived/at_{step}/brought"):
            self._build(step, checks)  # an earlier delivery that failed
            step += 1
        fresh = {}
        for name, df in raw.items():
            index = KeyIndex(f"{self.home}/staged/{name}", df.schema, DELIVERED[name])
            index.catch_up(self.spark)
            overwrite_table(index.missing(df), f"{self.home}/arrived/at_{step}/{name}")
            fresh[name] = self._arrived(step, name, df.schema)
        self._refuse_late(fresh.get("entity_points"))
        names = [(name, df.schema.json()) for name, df in fresh.items() if not df.isEmpty()]
        if not names:
            return step - 1
        brought = self.spark.createDataFrame(names, "name string, fields string")
        brought.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/arrived/at_{step}/brought")
        self._build(step, checks)
        return step

    def _arrived(self, step: int, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.home}/arrived/at_{step}/{name}")

    def _refuse_late(self, points: DataFrame | None) -> None:
        last = self.entities._steps()
        if points is None or not last:
            return
        built = self.dim("period").where(F.col("date_start") <= F.lit(last[-1][1])).select("season", "period_num")
        late = points.join(built, _GRAIN, "left_semi").count()
        if late:
            raise ValueError(f"{late} points belong to periods that are built already")

    def _build(self, step: int, checks: dict | None) -> None:
        """Store and build what a step brought; repeating it gives the same."""
        brought = self.spark.read.parquet(f"{self.home}/arrived/at_{step}/brought").collect()
        fresh = {r["name"]: self._arrived(step, r["name"], T.StructType.fromJson(json.loads(r["fields"]))) for r in brought}
        for name, df in fresh.items():
            KeyIndex(f"{self.home}/staged/{name}", df.schema, DELIVERED[name]).append(df)
        self._extend_dims(fresh)
        if "entity_points" in fresh and self._is_new(step):
            self._build_entities(step, fresh, checks)
        if "team_points" in fresh:
            self._build_teams(step, fresh)
        self.spark.createDataFrame([(step,)], "step int").coalesce(1).write.mode("append").parquet(f"{self.home}/done")

    def _is_new(self, step: int) -> bool:
        return not is_complete(self.spark, f"{self.home}/built/entities_done/at_{step}")

    def _extend_dims(self, fresh: dict[str, DataFrame]) -> None:
        """Number unseen entities, teams and periods on from those that are known."""
        if "entity_points" in fresh:
            names = fresh["entity_points"].select(F.col("entity").alias("entity_name"))
            KeyIndex(f"{self.home}/dim_entity", _schema(DIM_ENTITY), "entity_name", "entity_id").extend(names, "entity_name")
        if "team_points" in fresh:
            names = fresh["team_points"].select(F.col("season").cast("int").alias("season"), F.col("team").alias("team_name"))
            KeyIndex(f"{self.home}/dim_team", _schema(DIM_TEAM), ["season", "team_name"], "team_id").extend(names, ["season", "team_name"])
        if "meetings" in fresh:
            index = KeyIndex(f"{self.home}/dim_period", _schema(DIM_PERIOD), ["season", "date_start"], "period_id")
            known = self.dim("period")
            new = fresh["meetings"].select(F.col("season").cast("int").alias("season"), "period_name", "date_start", "is_special")
            new = new.join(known.select("season", "date_start"), ["season", "date_start"], "left_anti")  # one row per meeting
            index.extend(number_within_season(new, "season", "date_start", existing=known), ["season", "period_num"])

    def _rated(self, step: int, results: DataFrame) -> DataFrame:
        """Ratings of the arriving results from the state of the step before, and the state after them."""
        rows = results.filter(F.col("rating_position").isNotNull() & F.col("entity").isNotNull()).withColumn("pool", F.lit(0))
        kind = empty_state(rows, "pool", "entity").schema
        before = [s for s in self.steps() if is_complete(self.spark, f"{self.home}/built/rating_state/at_{s}")]
        if not before:  # all periods at once
            rated = self._write(sequential_rating(rows.drop("pool"), params=self.params), "rating", step)
            seasons = rated.select("season").distinct()
            ranks = seasons.withColumn("changes", F.expr("cast(dense_rank() over (order by season) - 1 as int)"))  # calendar-sized
            last = rated.groupBy("entity").agg(F.max_by(F.struct("rating_after", "season"), F.struct("season", "period_id")).alias("x"))
            state = last.select(F.lit(0).alias("pool"), "entity", F.col("x.rating_after").alias("rating"), F.col("x.season").alias("last_season"))
            state = state.join(ranks.withColumnRenamed("season", "last_season"), "last_season").select(*kind.names)
            self._write(state, "rating_state", step)
            return rated
        state = self.spark.read.schema(kind).parquet(f"{self.home}/built/rating_state/at_{before[-1]}")
        out = None
        # calendar-sized: the periods of one delivery
        for season, period in rows.select("season", "period_id").distinct().orderBy("season", "period_id").collect():
            one = rows.where((F.col("season") == season) & (F.col("period_id") == period))
            if not one.groupBy("entity").count().where("count > 1").isEmpty():
                raise ValueError(f"repeated entity in period {period}")
            rated = self._write(rating_step(state, one, "pool", "entity", self.params), f"rating_of_period/{season}-{period}", step)
            state = self._write(next_state(state, rated, "pool", "entity").select(*kind.names), f"state_of_period/{season}-{period}", step)
            columns = ["season", "period_id", "entity", "rating_position", "rating_before", "rating_delta", "rating_after"]
            out = rated.select(columns) if out is None else out.unionByName(rated.select(columns))
        self._write(state, "rating_state", step)
        return self._write(out, "rating", step)

    def _build_entities(self, step: int, fresh: dict[str, DataFrame], checks: dict | None) -> None:
        points, periods = fresh["entity_points"], self.dim("period")
        arriving = points.select(*_GRAIN).distinct().join(periods, _GRAIN)
        ids = arriving.select(*_GRAIN, "period_id")
        keyed = {name: fresh[name].join(ids, _GRAIN) for name in ("placements", "seeds") if name in fresh}
        dims = {n: self.dim(n) for n in ("entity", "team")}
        placements = keyed["placements"].withColumnRenamed("finish_position", "position")
        resolved = resolve_positions(placements, ["season", "period_id"])
        rating = self._rated(step, resolved.select("season", "period_id", "entity", "rating_position"))
        spine = points.join(ids, _GRAIN).select("period_id", "entity")
        if self.entities._steps():  # an entity without a result carries its last rating on
            held = self.entities.latest().select("entity_id", "rating_after").join(dims["entity"], "entity_id")
            held = held.select(F.lit(-1).cast("long").alias("period_id"), F.col("entity_name").alias("entity"), "rating_after")
            spine = spine.unionByName(held.select("period_id", "entity"))
            rating = rating.unionByName(held, allowMissingColumns=True)
        expanded = expand_rating(rating, spine, ["period_id", "entity"], self.params.init).where("period_id >= 0")
        prices = self._of_periods("entity_prices", fresh, arriving)
        seeds = keyed["seeds"].join(dims["entity"].withColumnRenamed("entity_name", "entity"), "entity")
        fact = build_entity_fact(points, prices, dims["entity"], arriving, dims["team"], keyed["placements"], expanded, seeds)
        fact = self._write(fact, "entity_fact", step)
        if checks:
            raise_if_any(run_suite({"entity_fact": fact}, {k: v for k, v in checks.items() if k == "entity_fact"}), "checks failed")
        if len(self.entities._steps()) == len([s for s in self.steps() if self._has("entity_fact", s)]):
            self.entities.extend(fact)
        overwrite_table(self.spark.createDataFrame([(step,)], "step int"), f"{self.home}/built/entities_done/at_{step}")

    def _has(self, name: str, step: int) -> bool:
        return is_complete(self.spark, f"{self.home}/built/{name}/at_{step}")

    def _build_teams(self, step: int, fresh: dict[str, DataFrame]) -> None:
        points, periods = fresh["team_points"], self.dim("period")
        arriving = points.select(*_GRAIN).distinct().join(periods, _GRAIN)
        prices = self._of_periods("team_prices", fresh, arriving)
        fact = self._write(build_team_fact(points, prices, arriving, self.dim("team")), "team_fact", step)
        if len(self.teams._steps()) == len([s for s in self.steps() if self._has("team_fact", s)]):
            self.teams.extend(fact)

    def _of_periods(self, name: str, fresh: dict[str, DataFrame], arriving: DataFrame) -> DataFrame:
        """Staged rows of the arriving periods, whichever delivery brought them."""
        schema = fresh[name].schema if name in fresh else self.spark.read.parquet(f"{self.home}/staged/{name}").schema
        seasons = [r[0] for r in arriving.select("season").distinct().collect()]  # calendar-sized
        rows = self.staged(name, schema).where(F.col("season").isin(seasons))
        return rows.join(arriving.select(*_GRAIN), _GRAIN, "left_semi")
