"""The state of a rating as a log of the rows each period changed.

Writing the whole state after every period costs periods times entities. Here a period
adds one run that holds only its own entities; ``FAN`` runs of a level are merged into one
of the next, which keeps the newest row of an entity. A row is thus rewritten once a level,
so what is written grows with the arrivals (times the logarithm of the number of periods), and
a reader meets fewer than ``FAN`` runs of each level.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.common import Order, as_list, attach

FAN = 8
MANIFEST = "level int, step long, path string"


class Run(NamedTuple):
    level: int
    step: int  # the newest period in it
    path: str


class StateLog:
    """Ratings by pool and entity, with the last season and the season changes seen by then.

    ``runs`` names the files that make up the state; a log is continued from those of an earlier
    one. Runs are never changed, only left out of ``runs`` once they are merged, so a step
    that fails can be repeated from the runs before it. NULL pools and entities are keys like others.
    """

    def __init__(self, spark: SparkSession, home: str, schema: T.StructType, pool: Order, entity: str, runs: Sequence[Run] = ()):
        self.spark, self.home, self.pool = spark, home, as_list(pool)
        self.keys = [*self.pool, entity]
        self.values = [f.name for f in schema if f.name not in self.keys]
        self.schema = T.StructType([*schema.fields, T.StructField("step", T.LongType())])
        self.runs = list(runs)

    def _rows(self, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[r.path for r in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.values, "step"), "step").alias("__last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "__last.*")

    def latest(self, only: DataFrame | None = None) -> DataFrame:
        """The state, or that of the entities of ``only``; other entities' rows are not shuffled."""
        rows = self._rows(self.runs)
        if only is not None:
            rows = attach(rows, only.select(*self.keys).distinct().hint("merge"), self.keys, "left_semi")
        return self._newest(rows).drop("step")

    def clock(self) -> DataFrame:
        """Season and season changes of each pool so far; neither ever falls, so stale rows do no harm."""
        return self._rows(self.runs).groupBy(*self.pool).agg(
            F.max("last_season").alias("last_season"), F.max("changes").alias("changes")
        )

    def _write(self, rows: DataFrame, level: int, step: int) -> Run:
        run = Run(level, step, f"{self.home}/level={level}-step={step}")
        rows.select(*self.schema.names).write.mode("overwrite").parquet(run.path)
        return run

    def add(self, rated: DataFrame) -> None:
        """Take in what a period rated."""
        step = max((r.step for r in self.runs), default=0) + 1
        fresh = rated.select(
            *self.keys, F.col("rating_after").alias("rating"), F.col("season").alias("last_season"), "changes",
            F.lit(step).cast("long").alias("step"),
        )
        self.runs.append(self._write(fresh, 0, step))
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= FAN:
            merged = self._write(self._newest(self._rows(full)), level + 1, step)
            self.runs = [r for r in self.runs if r.level != level] + [merged]
            level += 1

    def manifest(self) -> DataFrame:
        """The runs as rows, to be written and read again by ``runs_of``."""
        return self.spark.createDataFrame(self.runs, MANIFEST).coalesce(1)


def runs_of(manifest: DataFrame) -> list[Run]:
    """Runs of a written manifest: a few for each level."""
    return [Run(*r) for r in manifest.select("level", "step", "path").collect()]
