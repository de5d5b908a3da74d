"""Parquet tables with declared schemas: S1, S5-S9, S11, S12."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.common import Order, as_list, ordering
from leaguelens.operators.ordering import one_per_key
from leaguelens.session import tune

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Scan a table under its declared schema, without a footer-inference pass."""
    return tune(spark).read.schema(schema or SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table's rows; none where nothing was written yet. Any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def overwrite_table(df: DataFrame, path: str, partition_by: Order = None) -> None:
    """Create or replace a table."""
    df.write.mode("overwrite").partitionBy(*as_list(partition_by)).parquet(path)


def append_table(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Append the listed columns, in that order, under the log's types."""
    df.select(*cols).write.mode("append").parquet(path)


def new_rows(df: DataFrame, target: DataFrame, keys: Order) -> DataFrame:
    """Rows whose key the target lacks, one per key, the least by its other columns."""
    keys = as_list(keys)
    return one_per_key(df.join(target.select(*keys), keys, "left_anti"), keys)


def append_new_only(df: DataFrame, path: str, keys: Order) -> None:
    """Append the rows whose key is absent; running it twice changes nothing."""
    target = df.sparkSession.read.schema(df.schema).parquet(path)
    new_rows(df, target, keys).write.mode("append").parquet(path)


def replace_slice(df: DataFrame, patch: DataFrame, pred: str | Column) -> DataFrame:
    """Drop the rows that satisfy ``pred`` and add the patch.

    Parquet has no DELETE, so this returns the new table for S5.
    """
    cond = F.expr(pred) if isinstance(pred, str) else pred
    return df.filter(~F.coalesce(cond, F.lit(False))).unionByName(patch)


def replace_partitions(patch: DataFrame, path: str, partition_by: Order) -> None:
    """S8 in place: the partitions that the patch has rows of are replaced on disk, all others stay as they are.

    A slice is one or more whole partitions. One the patch has no row of is not emptied.
    """
    writer = patch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*as_list(partition_by)).parquet(path)


def export_mart(df: DataFrame, path: str, order: Order) -> None:
    """Write an ordered mart; file order follows the sort."""
    df.orderBy(*ordering(order)).write.mode("overwrite").parquet(path)


def catalog_summary(spark: SparkSession, folder: str, names: Sequence[str] = tuple(SCHEMAS)) -> DataFrame:
    """Rows, columns and column types per table, as one lazy query."""
    parts = []
    for name in names:
        df = read_table(spark, folder, name)
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"),
                "n_rows",
                F.lit(len(df.columns)).cast("long").alias("n_columns"),
                F.lit(types).alias("column_types"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column counts, min, max, mean, infinities and skewness, in one pass."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    aggs, cells = [], []
    null = F.lit(None).cast("double")
    for i, c in enumerate(df.columns):
        col = F.col(c)
        parts = {
            "n_rows": F.count(F.lit(1)),
            "n_null": F.count_if(col.isNull()),
            "n_value": F.count(col),
        }
        if c in numeric:
            d = col.cast("double")
            n = F.count(col).cast("double")
            # the data-frame skewness is the bias-corrected one
            fix = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2))
            parts |= {
                "min_value": F.min(d),
                "max_value": F.max(d),
                "mean_value": F.avg(d),
                "n_inf": F.count_if(d.isin(float("inf"), float("-inf"))),
                "skew": F.skewness(d) * fix,
            }
        names = []
        for k, e in parts.items():
            aggs.append(e.alias(f"a{i}_{k}"))
            names.append(F.col(f"a{i}_{k}").alias(k))
        if c not in numeric:
            names += [null.alias(k) for k in ("min_value", "max_value", "mean_value")]
            names += [F.lit(None).cast("long").alias("n_inf"), null.alias("skew")]
        cells.append(F.struct(F.lit(c).alias("column_name"), *names))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))
