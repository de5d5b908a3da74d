"""An index of a table's keys, for appends that do not read the table.

The keys of a Parquet table are kept beside it, one folder per hash bucket. An append
reads the buckets that its own keys fall into and nothing of the table's rows. What the
index covers is recorded by data file, so it follows whatever wrote to the table: files it
has not seen are read once, keys only; if files it knows are gone, it is built anew. A
failure between the append and the index therefore heals with the next append.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.common import Order, as_list, number_rows
from leaguelens.operators.ordering import one_per_key
from leaguelens.sources.tables import read_or_empty

BUCKETS = 256
BUCKET = "__bucket"


class KeyIndex:
    """The index of ``path`` by ``keys``; ``number``, if named, is an ascending id whose maximum is kept too.

    It lies in a folder whose name starts with ``_``, which readers of the table skip and an
    overwrite of the table removes. Keys match as NULL-safe values. One writer at a time.
    """

    def __init__(self, path: str, schema: T.StructType, keys: Order, number: str | None = None, buckets: int = BUCKETS):
        self.path, self.schema, self.keys, self.number, self.buckets = path, schema, as_list(keys), number, buckets
        self.home = f"{path}/_keys_{'_'.join(self.keys)}_{buckets}"
        self.key_schema = T.StructType([schema[k] for k in self.keys])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _covered(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.home}/files", T.StructType.fromDDL("file string, high long"))

    def held(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The indexed keys, of some buckets only where these are named."""
        rows = read_or_empty(spark, f"{self.home}/keys", T.StructType([*self.key_schema, T.StructField(BUCKET, T.IntegerType())]))
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def catch_up(self, spark: SparkSession) -> int:
        """Index the files the index has not seen yet and return their number."""
        try:
            files = set(spark.read.schema(self.schema).parquet(self.path).inputFiles())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = set()
        known = {r["file"] for r in self._covered(spark).select("file").collect()}
        mode = "append"
        if known - files:  # rewritten or compacted
            known, mode = set(), "overwrite"
        fresh = sorted(files - known)
        if not fresh and mode == "append":
            return 0
        if not fresh:
            rows = spark.createDataFrame([], self.schema)
        else:
            rows = spark.read.schema(self.schema).option("basePath", self.path).parquet(*fresh)
        keys = rows.select(*self.keys).distinct().withColumn(BUCKET, self._bucket())
        keys.repartition(BUCKET).write.mode(mode).partitionBy(BUCKET).parquet(f"{self.home}/keys")
        high = rows.agg(F.max(self.number)).first()[0] if self.number else None
        names = spark.createDataFrame([(f, high) for f in fresh], "file string, high long")
        names.coalesce(1).write.mode(mode).parquet(f"{self.home}/files")
        return len(fresh)

    def high(self, spark: SparkSession) -> int:
        """The highest number that the table holds, 0 if it is empty."""
        return self._covered(spark).agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]

    def missing(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key the table lacks, one per key, the least by its other columns."""
        spark = df.sparkSession
        touched = sorted(r[0] for r in df.select(self._bucket()).distinct().collect())  # at most ``buckets``
        held = self.held(spark, touched)
        held = held.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(self.keys)], F.col(BUCKET).alias("__b"))
        same = F.col(BUCKET) == F.col("__b")
        for n, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"__k{n}"))
        fresh = df.withColumn(BUCKET, self._bucket()).join(held, same, "left_anti").drop(BUCKET)
        return one_per_key(fresh, self.keys)

    def append(self, df: DataFrame) -> None:
        """Append the rows whose key is absent; repeating it, also after a failure, changes nothing."""
        spark = df.sparkSession
        self.catch_up(spark)
        self.missing(df).write.mode("append").parquet(self.path)
        self.catch_up(spark)

    def extend(self, new: DataFrame, order: Order) -> None:
        """Append unseen keys, numbered on from the table's highest ``number`` in the order given."""
        spark = new.sparkSession
        self.catch_up(spark)
        last = self.high(spark)
        names = [f.name for f in self.schema if f.name != self.number]
        added = number_rows(self.missing(new.select(*names)), [], order, self.number)
        kind = self.schema[self.number].dataType
        added = added.withColumn(self.number, (F.col(self.number) + last).cast(kind))
        added.select(*self.schema.names).write.mode("append").parquet(self.path)
        self.catch_up(spark)
