"""The test tables read as a season competition, in Spark and in SQL.

supplier = entity, its nation = team, its region = pool, shipping month =
period; points and prices are sums and means over the month's line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.operators.common import GROUP_ROWS, fits_one_task, number_rows
from leaguelens.sources.tables import read_table

FACT0 = """
fact0 AS (
  SELECT s.s_suppkey AS entity_id, CAST(s.s_nationkey AS BIGINT) AS team_id,
    CAST(n.n_regionkey AS BIGINT) AS pool_id,
    CAST(year(l.l_shipdate) AS INTEGER) AS season, CAST(month(l.l_shipdate) AS INTEGER) AS period_num,
    CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS BIGINT) AS period_id,
    round(avg(l.l_extendedprice / nullif(l.l_quantity, 0)) / 100 + 1e-9, 4) AS price,
    round(sum(l.l_quantity * (1 - l.l_discount)) / 10, 4) AS points
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY ALL)"""

FACT = (
    FACT0
    + """,
fact AS (
  SELECT *, period_num % 4 = 0 AS is_special,
    CAST(1500 + (season * 7 + entity_id) % 40 AS DOUBLE) AS rating_before,
    CAST(1500 + (season * 7 + period_num + entity_id) % 40 AS DOUBLE) AS rating_after,
    CASE WHEN (entity_id + period_num) % 11 <> 0 THEN row_number() OVER (
      PARTITION BY pool_id, period_id ORDER BY price DESC, entity_id) END AS seed_position,
    row_number() OVER (PARTITION BY pool_id, period_id ORDER BY points DESC, entity_id) AS position
  FROM fact0)"""
)

PERIODS = """
dim_period AS (
  SELECT season, period_num, period_id, 'Round ' || period_num AS period_name,
    make_timestamp(season, period_num, 1, 0, 0, 0) AS date_start, period_num % 4 = 0 AS is_special
  FROM (SELECT DISTINCT year(l_shipdate)::INTEGER AS season, month(l_shipdate)::INTEGER AS period_num,
    (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS period_id FROM lineitem))"""

ENTITIES = """
dim_entity AS (
  SELECT s_suppkey AS entity_id, lower(s_name) AS entity_name, 'S' || s_suppkey AS acronym FROM supplier)"""

TEAMS = """
dim_team AS (
  SELECT CAST(n_nationkey AS BIGINT) AS team_id, lower(n_name) AS team_name FROM nation)"""

DIMS = ",".join([PERIODS, ENTITIES, TEAMS])


def day(year: Column, month: Column, of_month: int) -> Column:
    """Midnight of a day."""
    return F.make_date(year, month, F.lit(of_month)).cast("timestamp_ntz")


def base_fact(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (entity, period); line items are combined before any join."""
    items = read_table(spark, folder, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount")
    monthly = (
        items.groupBy(
            F.col("l_suppkey").alias("s_suppkey"),
            F.year("l_shipdate").alias("season"),
            F.month("l_shipdate").alias("period_num"),
        )
        .agg(
            F.round(F.avg(F.col("l_extendedprice") / F.nullif(q, F.lit(0.0))) / 100 + 1e-9, 4).alias("price"),
            F.round(F.sum(q * (1 - d)) / 10, 4).alias("points"),
        )
    )
    suppliers = read_table(spark, folder, "supplier")
    nations = read_table(spark, folder, "nation")
    return (
        monthly.join(suppliers, "s_suppkey")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("entity_id"),
            F.col("s_nationkey").cast("long").alias("team_id"),
            F.col("n_regionkey").cast("long").alias("pool_id"),
            "season",
            "period_num",
            (F.col("season") * 100 + F.col("period_num")).cast("long").alias("period_id"),
            "price",
            "points",
        )
    )


def fact(spark: SparkSession, folder: str) -> DataFrame:
    """The fact with positions, seeds and stand-in ratings."""
    grid = ["pool_id", "period_id"]
    # an entity is once in a grid, so the size of its pool bounds the grid
    pools = read_table(spark, folder, "supplier").join(
        read_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    limit = None if fits_one_task(pools, "n_regionkey", GROUP_ROWS) else GROUP_ROWS
    out = number_rows(base_fact(spark, folder), grid, ["-price", "entity_id"], "seed_position", limit)
    out = number_rows(out, grid, ["-points", "entity_id"], "position", limit)
    e, s, p = F.col("entity_id"), F.col("season"), F.col("period_num")
    return out.withColumns(
        {
            "is_special": p % 4 == 0,
            "rating_before": (1500 + (s * 7 + e) % 40).cast("double"),
            "rating_after": (1500 + (s * 7 + p + e) % 40).cast("double"),
            "seed_position": F.when((e + p) % 11 != 0, F.col("seed_position")),
        }
    )


def dim_period(spark: SparkSession, folder: str) -> DataFrame:
    months = (
        read_table(spark, folder, "lineitem")
        .select(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("period_num"))
        .distinct()
    )
    return months.select(
        "season",
        "period_num",
        (F.col("season") * 100 + F.col("period_num")).cast("long").alias("period_id"),
        F.concat(F.lit("Round "), F.col("period_num").cast("string")).alias("period_name"),
        day(F.col("season"), F.col("period_num"), 1).alias("date_start"),
        (F.col("period_num") % 4 == 0).alias("is_special"),
    )


def dim_entity(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        F.lower("s_name").alias("entity_name"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("acronym"),
    )


def dim_team(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("team_id"), F.lower("n_name").alias("team_name")
    )
