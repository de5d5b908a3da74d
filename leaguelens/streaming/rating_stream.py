"""Rating kept up to date from a stream of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leaguelens.operators.common import Order, as_list
from leaguelens.plans.rating import PERIOD_ROWS, RatingParams, empty_state, rating_step
from leaguelens.plans.rating_log import MANIFEST, StateLog, runs_of


def _time() -> Column:
    return F.struct("season", "period_id")



class _Home:
    """The folders of a rating stream: each batch writes below its own id, so a replay overwrites itself."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, pool: Order, entity: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.pool, self.entity = as_list(pool), entity
        self.state_schema = empty_state(spark.createDataFrame([], schema), self.pool, entity).schema
        self.manifest_schema = T.StructType.fromDDL(MANIFEST)
        self.closed_schema = T.StructType([schema["season"], schema["period_id"]])

    def write(self, df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema or df.schema).parquet(f"{self.path}/{name}")

    def read(self, name: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """What a batch wrote; empty before the first batch."""
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{batch_id}")

    def at(self, time) -> Column:
        """A time as a value to compare ``_time`` with."""
        return F.struct(*[F.lit(time[f.name]).cast(f.dataType) for f in self.closed_schema])

    def log(self, batch_id: int, into: int | None = None) -> StateLog:
        """The state after a batch, whose next runs belong to batch ``into``."""
        runs = runs_of(self.read("log", batch_id, self.manifest_schema))
        return StateLog(self.spark, f"{self.path}/state/{into}", self.state_schema, self.pool, self.entity, runs)

    def rate(self, rows: DataFrame, log: StateLog, into: str, params: RatingParams, period_rows: int) -> None:
        """Rate whole periods in order and add them to the state."""
        # calendar-sized: the periods of one batch
        periods = rows.select("season", "period_id").distinct().orderBy("season", "period_id").collect()
        for season, period in periods:
            one = rows.filter((F.col("season") == season) & (F.col("period_id") == period))
            if not one.groupBy(*self.pool, self.entity).count().filter("count > 1").isEmpty():
                raise ValueError(f"repeated {self.entity} in period {period} of season {season}")
            rated = rating_step(log.latest(one), one, self.pool, self.entity, params, period_rows, log.clock())
            log.add(self.write(rated, f"{into}/period={season}-{period}"))


def stream_rating(
    stream: DataFrame,
    home: str,
    pool: Order,
    entity: str,
    checkpoint: str,
    params: RatingParams = RatingParams(),
    period_rows: int = PERIOD_ROWS,
) -> StreamingQuery:
    """Rate results as they arrive; equals the batch rating when periods arrive in order.

    A period is rated once a row of a later one has been seen; until then its rows wait,
    so it may be spread over batches. A row of a period that is rated already, and an
    entity twice in a period, raise. Every batch writes its ratings, what they change in the
    state (``rating_log``) and the rows that wait under its own id, and starts from those of the
    batch before; a replayed batch overwrites what it wrote. ``open_ratings`` rates what waits.
    """
    files = _Home(stream.sparkSession, home, stream.schema, pool, entity)

    def rate(batch: DataFrame, batch_id: int) -> None:
        # from here on these are batch jobs of the main session, with its adaptive execution
        batch = files.write(batch, f"results/{batch_id}", files.schema)
        closed = files.read("closed", batch_id - 1, files.closed_schema).agg(F.max(_time())).first()[0]
        if closed is not None:
            late = batch.filter(_time() <= files.at(closed)).limit(1).collect()
            if late:
                raise ValueError(f"late result: {late[0].asDict()} after period {closed['period_id']} was rated")
        rows = batch.unionByName(files.read("waiting", batch_id - 1, files.schema))
        newest = rows.agg(F.max(_time())).first()[0]
        log = files.log(batch_id - 1, into=batch_id)
        if newest is not None:
            last = files.at(newest)
            files.rate(rows.filter(_time() < last), log, f"rated/batch={batch_id}", params, period_rows)
            before = rows.filter(_time() < last).select("season", "period_id").distinct()
            rows = rows.filter(_time() == last)
        else:
            before = files.spark.createDataFrame([], files.closed_schema)
        earlier = files.read("closed", batch_id - 1, files.closed_schema)
        files.write(rows, f"waiting/{batch_id}")
        files.write(before.unionByName(earlier).agg(F.max(_time()).alias("t")).select("t.*"), f"closed/{batch_id}")
        files.write(log.manifest(), f"log/{batch_id}", files.manifest_schema)

    return (
        stream.writeStream.foreachBatch(rate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_ratings(
    spark: SparkSession,
    schema: T.StructType,
    home: str,
    pool: Order,
    entity: str,
    batch_id: int,
    params: RatingParams = RatingParams(),
    period_rows: int = PERIOD_ROWS,
) -> DataFrame:
    """Ratings of the period that still waits after a batch; what the stream holds stays as it is."""
    files = _Home(spark, home, schema, pool, entity)
    waiting, log = files.read("waiting", batch_id, schema), files.log(batch_id)
    return rating_step(log.latest(waiting), waiting, files.pool, entity, params, period_rows, log.clock())
