"""Features kept up to date by period, without reading old periods again.

Beside the features a state is written: of each key the rows its windows can still look at
(a halo of ``REACH`` rows), and its latest features and rating. A step computes the arriving
periods from the halo and the arrivals alone. Every step is a set of written tables that
counts once its marker is there; a step that failed is written over by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.operators.ordering import best_row
from leaguelens.operators.windows import windowed
from leaguelens.plans import features as fe
from leaguelens.sources.tables import overwrite_table

REACH = 5  # rows that the longest window looks back


@dataclass(frozen=True)
class Kind:
    """What differs between features of entities and of teams."""

    key: str
    prepare: Callable[[DataFrame], DataFrame]  # columns that need the peers of a row
    columns: Callable  # windows over the key's rows
    finish: Callable[[DataFrame], DataFrame]  # the features of rows with windows
    halo: list[str]  # what windows look at
    carry: list[str]  # kept of the latest row beside its features
    latest: str = ""  # what the latest rows are kept by, if not by the key


ENTITY = Kind("entity_id", fe._with_gap, fe._entity_columns, fe._entity_rows, ["price", "points", "seed_position", "__gap"], ["rating_after"])
TEAM = Kind("team_id", lambda df: df, fe._team_columns, fe._team_rows, ["price", "points"], [])
# ids change with the season, names do not
TEAM_BY_NAME = replace(TEAM, key="team_name", latest="team_id")


class FeatureState:
    """The features of one kind under ``home``, one folder per step.

    ``order`` is the column that periods follow each other by. A period arrives whole, with all
    rows of its peers, and after every period before it.
    """

    def __init__(self, spark: SparkSession, home: str, kind: Kind, order: str = "period_id"):
        self.spark, self.home, self.kind, self.order = spark, home, kind, order

    def _steps(self) -> list[tuple[int, object]]:
        """(step, highest order value) of the finished steps, one row each."""
        try:
            rows = self.spark.read.parquet(f"{self.home}/done").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["step"], r["upto"]) for r in rows)

    def _read(self, name: str, step: int, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.home}/{name}/at_{step}")

    def extend(self, arrivals: DataFrame) -> DataFrame:
        """Add the arriving periods and return their features.

        Raises on rows that are not later than what is there: they would change features that
        were given out. An empty delivery changes nothing.
        """
        kind, done = self.kind, self._steps()
        span = arrivals.agg(F.min(self.order).alias("low"), F.max(self.order).alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            return kind.finish(arrivals_with(kind, arrivals, self.order)).limit(0)
        if done and span["low"] <= done[-1][1]:
            late = arrivals.where(F.col(self.order) <= F.lit(done[-1][1])).count()
            raise ValueError(f"{late} rows are not later than {self.order} {done[-1][1]}")
        step = done[-1][0] + 1 if done else 0
        kept = [kind.key, self.order, *kind.halo]
        rows = kind.prepare(arrivals).withColumn("__new", F.lit(True))
        if done:
            old = self._read("halo", step - 1, rows.select(*kept).schema)
            rows = rows.unionByName(old.withColumn("__new", F.lit(False)), allowMissingColumns=True)
        rows = windowed(rows, kind.key, self.order, kind.columns, max_group_rows=None)
        overwrite_table(rows, f"{self.home}/rows/at_{step}")
        rows = self._read("rows", step, rows.schema)
        features = kind.finish(rows.where("__new"))
        overwrite_table(features, f"{self.home}/features/at_{step}")
        features = self._read("features", step, features.schema)
        # no key has more rows here than the halo and the arriving periods
        back = F.row_number().over(Window.partitionBy(kind.key).orderBy(F.desc(self.order)))
        overwrite_table(rows.select(*kept, back.alias("__back")).where(F.col("__back") <= REACH).drop("__back"), f"{self.home}/halo/at_{step}")
        latest = features
        if kind.carry:
            carried = arrivals.select(kind.key, F.col(self.order).alias("__at"), *kind.carry)
            same = (features[kind.key] == carried[kind.key]) & (features[self.order] == carried["__at"])
            latest = features.join(carried, same, "left").select(features["*"], *[carried[c] for c in kind.carry])
        if done:
            latest = latest.unionByName(self._read("latest", step - 1, latest.schema))
        overwrite_table(best_row(latest, kind.latest or kind.key, f"-{self.order}"), f"{self.home}/latest/at_{step}")
        upto = self.spark.createDataFrame([(step, span["high"])], f"step int, upto {arrivals.schema[self.order].dataType.simpleString()}")
        upto.coalesce(1).write.mode("append").parquet(f"{self.home}/done")
        return features

    def features(self) -> DataFrame:
        """All features of the finished steps."""
        steps = [step for step, _ in self._steps()]
        return self.spark.read.parquet(*[f"{self.home}/features/at_{step}" for step in steps])

    def latest(self) -> DataFrame:
        """The latest features of every key, and what is carried with them."""
        return self._read("latest", self._steps()[-1][0])


def arrivals_with(kind: Kind, arrivals: DataFrame, order: str) -> DataFrame:
    return windowed(kind.prepare(arrivals), kind.key, order, kind.columns, max_group_rows=None)


def scoring_frames(
    entities: FeatureState, teams: FeatureState, target: DataFrame, prices: DataFrame, dim_entity: DataFrame, team_prices: DataFrame, dim_team: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """G5 and G6 from the state: history is not read, only the latest row of each key."""
    latest = entities.latest()
    frame = fe.scoring_frame_entity(target, prices, dim_entity, latest, latest)
    return frame, fe.scoring_frame_team(target, team_prices, dim_team, teams.latest())
