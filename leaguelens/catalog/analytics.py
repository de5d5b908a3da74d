"""Queries for keys, quality checks, staging, facts, features, rating and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.catalog.fixture import (
    DIMS,
    FACT,
    FACT0,
    PERIODS,
    base_fact,
    day,
    dim_entity,
    dim_period,
    dim_team,
    fact,
)
from leaguelens.catalog.registry import ORACLE, query, rnd, tidy
from leaguelens.operators import keys as ky
from leaguelens.operators import quality as ql
from leaguelens.operators import windows as wn
from leaguelens.plans import draws as dw
from leaguelens.plans import facts as fa
from leaguelens.plans import feature_state as fs
from leaguelens.plans import features as fe
from leaguelens.plans import increment as inc
from leaguelens.plans import outcomes as oc
from leaguelens.plans import rating as rt
from leaguelens.plans import staging as sg
from leaguelens.plans.profile import source_name_reconciliation, unresolved_names
from leaguelens.session import checkpointed, shared_folder
from leaguelens.sources import landing as ld
from leaguelens.sources import tables as tb
from leaguelens.sources.key_index import KeyIndex
from leaguelens.sources.tables import read_table

# ---------------------------------------------------------------- files


@query(
    "s2_read_csv",
    """SELECT o_orderkey, o_totalprice, o_orderdate + INTERVAL 23 HOUR + INTERVAL 30 MINUTE AS created_at FROM orders""",
)
def _(spark, d):
    path = shared_folder(spark, "csv")
    log = read_table(spark, d, "orders").select(
        F.monotonically_increasing_id().alias("Unnamed: 0"),
        "o_orderkey",
        "o_totalprice",
        F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" 23:30")).alias("created_at"),
    )
    ld.export_csv(log, path)
    schema = "`Unnamed: 0` long, o_orderkey long, o_totalprice double, created_at string"
    return ld.read_csv(spark, path, schema, ["created_at"]).withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )


@query("s3_read_json_landing", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path = shared_folder(spark, "json")
    cols = ["event_id", "user_id", "event_type", "value"]
    rows = read_table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("page"))
    # a file is one response: an array with a page of records
    body = rows.agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    body.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return ld.read_json_landing(spark, path, "event_id long, user_id long, event_type string, value double")


@query(
    "s4_read_wide_sheets",
    f"""WITH {FACT0}, g AS (SELECT season, entity_id FROM (SELECT DISTINCT season FROM fact0), (SELECT DISTINCT entity_id FROM fact0)
WHERE (season, entity_id) IN (SELECT (season, entity_id) FROM fact0)),
m AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS period_num)
SELECT CAST(g.entity_id AS VARCHAR) AS entity, CAST(m.period_num AS VARCHAR) AS period, f.price,
g.season || 'EntityPrice' AS source_sheet FROM g CROSS JOIN m LEFT JOIN fact0 f USING (season, entity_id, period_num)""",
)
def _(spark, d):
    home = shared_folder(spark, "sheets")
    rows = checkpointed(base_fact(spark, d))
    sheets = {}
    for (season,) in rows.select("season").distinct().orderBy("season").collect():
        months = list(range(1, 13))
        wide = rows.filter(F.col("season") == season).groupBy("entity_id").pivot("period_num", months).agg(F.max("price"))
        sheets[f"{season}EntityPrice"] = f"{home}/{season}"
        ld.export_csv(wide.toDF("Driver", *[f"{m}.0" for m in months]), f"{home}/{season}")
    return ld.read_wide_sheets(spark, sheets, "entity", "period", "price")


@query("s5_overwrite_table", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, d):
    path = shared_folder(spark, "table")
    rows = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    tb.overwrite_table(rows.filter("s_acctbal > 0"), path)
    tb.overwrite_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "s6_append_table",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
)
def _(spark, d):
    path = shared_folder(spark, "log")
    for table, key, name in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        tb.append_table(read_table(spark, d, table).selectExpr(f"{name} name", f"{key} id"), path, ["id", "name"])
    return spark.read.schema("id long, name string").parquet(path)


@query("s9_export_mart", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, d):
    path = shared_folder(spark, "mart")
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    tb.export_mart(rows, path, ["-o_totalprice", "o_orderkey"])
    return spark.read.schema(rows.schema).parquet(path)


@query("s10_export_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    path = shared_folder(spark, "export")
    ld.export_csv(read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return ld.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


# ---------------------------------------------------------------- keys


@query(
    "d1_assign_keys",
    "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS segment_id FROM (SELECT DISTINCT c_mktsegment FROM customer)",
)
def _(spark, d):
    rows = read_table(spark, d, "customer").select("c_mktsegment")
    return ky.assign_keys(rows, "c_mktsegment", "c_mktsegment", "segment_id")


@query(
    "d2_extend_keys",
    """WITH urgent AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
dim AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS member_id FROM urgent)
SELECT o_custkey, member_id FROM dim UNION ALL
SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) + (SELECT max(member_id) FROM dim)
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM urgent))""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders")
    first = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    dim = checkpointed(ky.assign_keys(first, "o_custkey", "o_custkey", "member_id"))
    return ky.extend_keys(orders.select("o_custkey"), dim, "o_custkey", "o_custkey", "member_id")


@query("d2_extend_keys_stored", ORACLE["d2_extend_keys"])
def _(spark, d):
    """The dimension as a stored table: two deliveries extend it through the index of its keys."""
    orders = read_table(spark, d, "orders")
    first = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    path = shared_folder(spark, "dimension")
    ky.assign_keys(first, "o_custkey", "o_custkey", "member_id").select("o_custkey", "member_id").write.parquet(path)
    schema = T.StructType.fromDDL("o_custkey long, member_id long")
    index = KeyIndex(path, schema, "o_custkey", number="member_id")
    index.extend(orders.select("o_custkey"), "o_custkey")
    index.extend(first, "o_custkey")
    return spark.read.schema(schema).parquet(path)


@query(
    "d3_number_within_season",
    """WITH m AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS season, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders)
SELECT season, day, row_number() OVER (PARTITION BY season ORDER BY day) + 3 AS period_num FROM m""",
)
def _(spark, d):
    days = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day"))
    known = days.select("season", F.lit(3).cast("long").alias("period_num")).distinct()
    return ky.number_within_season(days.distinct(), "season", "day", existing=known)


@query(
    "d4_flag_members",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS is_urgent FROM customer""",
)
def _(spark, d):
    urgent = read_table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    people = read_table(spark, d, "customer").select("c_custkey")
    return ky.flag_members(people, "c_custkey", urgent.select(F.col("o_custkey").alias("c_custkey")), "is_urgent")


@query("d5_next_run_id", "SELECT coalesce(max(o_orderkey), 0) + 1 AS next_o_orderkey FROM orders")
def _(spark, d):
    return ky.next_run_id(read_table(spark, d, "orders"), "o_orderkey")


@query(
    "d6_stability_check",
    """SELECT 'p_partkey' AS side, CAST(p_partkey AS VARCHAR) AS value, count(DISTINCT p_name) AS n_distinct FROM part
GROUP BY p_partkey HAVING count(DISTINCT p_name) > 1 UNION ALL
SELECT 'p_name', p_name, count(DISTINCT p_partkey) FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1""",
)
def _(spark, d):
    return ky.stability_check(read_table(spark, d, "part"), "p_partkey", "p_name")


@query(
    "d7_apply_overrides",
    """SELECT c_custkey, coalesce(o.best, c_acctbal) AS c_acctbal FROM customer LEFT JOIN
(SELECT o_custkey, max(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey""",
)
def _(spark, d):
    best = (
        read_table(spark, d, "orders")
        .filter("o_orderstatus = 'P'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("c_acctbal_override"))
    )
    rows = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ky.apply_overrides(rows, best, "c_custkey", {"c_acctbal": "c_acctbal_override"})


# ---------------------------------------------------------------- quality


@query(
    "v1_check_exists_nonempty",
    """SELECT 'missing' AS table_name, 'exists' AS check_name, NULL::VARCHAR AS column_name, 1::BIGINT AS n_bad
UNION ALL SELECT 'orders', 'not_empty', NULL, 1 FROM orders HAVING count(*) = 0
UNION ALL SELECT 'none', 'not_empty', NULL, 1 FROM orders HAVING count(*) FILTER (o_orderkey < 0) = 0""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders")
    tables = {"orders": orders, "none": orders.filter("o_orderkey < 0")}
    return ql.check_exists_nonempty(spark, tables, ["orders", "none", "missing"])


@query(
    "v2_check_columns",
    """SELECT 'orders' AS table_name, 'required_column' AS check_name, 'period_id' AS column_name, greatest(count(*), 1) AS n_bad FROM orders
UNION ALL SELECT 'orders', 'column_whitespace', ' o_orderkey', greatest(count(o_orderkey), 1) FROM orders""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_orderkey", " o_orderkey")
    return ql.check_columns(orders, ["o_custkey", "period_id"], "orders")


@query(
    "v3_check_not_null",
    f"""WITH {FACT} SELECT 'fact' AS table_name, 'not_null' AS check_name, 'seed_position' AS column_name,
count(*) - count(seed_position) AS n_bad FROM fact""",
)
def _(spark, d):
    return ql.check_not_null(fact(spark, d), ["entity_id", "price", "seed_position"], "fact")


@query(
    "v4_check_grain",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, d):
    return ql.check_grain(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v5_check_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
def _(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ql.check_range(rows, "l_quantity", 3, 48)


@query(
    "v6_check_coverage",
    f"""WITH {FACT0} SELECT pool_id, period_id, count(*) AS n_rows, count(DISTINCT entity_id) AS n_keys FROM fact0
GROUP BY ALL HAVING count(DISTINCT entity_id) < 18""",
)
def _(spark, d):
    return ql.check_coverage(base_fact(spark, d), ["pool_id", "period_id"], "entity_id", 18)


@query(
    "v7_check_resolved",
    """SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders
WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey WHERE o.o_orderkey IS NULL""",
)
def _(spark, d):
    last = read_table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
    rows = read_table(spark, d, "customer").select("c_custkey").join(last.agg(F.max("o_orderkey").alias("o_orderkey")), "c_custkey", "left")
    return ql.check_resolved(rows, ["o_orderkey"])


@query(
    "v7_check_join_coverage",
    """SELECT source, count(*) AS n_rows, count(CASE WHEN lang = 'en' THEN 1 END) AS n_filled FROM documents GROUP BY source
HAVING count(CASE WHEN lang = 'xx' THEN 1 END) = 0""",
)
def _(spark, d):
    rows = read_table(spark, d, "documents").withColumn("seen", F.when(F.col("lang") == "en", 1))
    none = ql.check_join_coverage(rows.withColumn("none", F.when(F.col("lang") == "xx", 1)), "source", "none")
    filled = rows.groupBy("source").agg(F.count("seen").alias("n_filled"))
    return none.drop("n_filled").join(filled, "source")


@query(
    "v8_check_schema_parity",
    """SELECT 'frame' AS table_name, 'missing_column' AS check_name, 'c_acctbal' AS column_name, greatest(count(c_acctbal), 1) AS n_bad FROM customer
UNION ALL SELECT 'frame', 'extra_column', 'first_order', greatest(count(DISTINCT o_custkey), 1) FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    rows = read_table(spark, d, "customer")
    first = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return ql.check_schema_parity(rows, rows.drop("c_acctbal").join(first, "c_custkey", "left"), "frame")


@query(
    "v9_check_leakage",
    f"WITH {FACT} SELECT 'frame' AS table_name, 'leakage' AS check_name, 'position' AS column_name, count(position) AS n_bad FROM fact",
)
def _(spark, d):
    frame = fact(spark, d).withColumn("points", F.lit(None).cast("double")).drop("rating_after")
    return ql.check_leakage(frame, ["points", "position", "status", "rating_after"], "frame")


@query(
    "v10_run_suite",
    f"""WITH {FACT}, found AS (SELECT 'fact' AS table_name, 'not_null' AS check_name, 'seed_position' AS column_name,
count(*) - count(seed_position) AS n_bad FROM fact
UNION ALL SELECT 'fact', 'range', 'points', count(*) FROM fact WHERE points < 1 OR points > 40
UNION ALL SELECT 'fact', 'required_column', 'laps', count(*) FROM fact
UNION ALL SELECT 'lines', 'grain', NULL, count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'fact', 'coverage', NULL, count(*) FROM (SELECT 1 FROM fact GROUP BY pool_id, period_id HAVING count(DISTINCT entity_id) < 18)
UNION ALL SELECT 'fact', 'resolved', NULL, count(*) FROM fact WHERE seed_position IS NULL
UNION ALL SELECT 'gone', 'exists', NULL, 1) SELECT * FROM found WHERE n_bad > 0""",
)
def _(spark, d):
    tables = {"fact": checkpointed(fact(spark, d)), "lines": read_table(spark, d, "lineitem")}
    spec = {
        "fact": {
            "columns": ["entity_id", "points", "laps"],
            "not_null": ["entity_id", "seed_position"],
            "grain": ["entity_id", "period_id"],
            "range": {"points": (1, 40)},
            "coverage": (["pool_id", "period_id"], "entity_id", 18),
            "resolved": ["seed_position"],
        },
        "lines": {"grain": ["l_orderkey", "l_linenumber"]},
        "gone": {"columns": ["x"]},
    }
    return ql.run_suite(tables, spec)


@query(
    "v11_check_rating",
    f"""WITH {FACT} SELECT season, period_id, count(*) - count(DISTINCT entity_id) AS n_repeated, 0::BIGINT AS n_missing,
{rnd("sum(rating_after - rating_before)")} AS delta_sum FROM fact GROUP BY ALL HAVING abs(sum(rating_after - rating_before)) > 1e-6""",
)
def _(spark, d):
    rows = fact(spark, d).withColumn("rating_delta", F.col("rating_after") - F.col("rating_before"))
    return tidy(ql.check_rating(rows, ["season", "period_id"], "entity_id"))


# ---------------------------------------------------------------- staging

_STATUS = """CASE WHEN (entity_id + period_id) % 17 = 0 THEN 'Did not start' WHEN (entity_id + period_id) % 13 = 0 THEN 'Retired'
WHEN (entity_id + period_id) % 19 = 0 THEN 'Disqualified' ELSE 'Finished' END"""
_POSITION = f"CASE WHEN {_STATUS} = 'Finished' THEN CAST(position AS DOUBLE) END"


def _results(spark, d):
    """The fact as raw results: statuses, blank positions, every row twice."""
    rows = fact(spark, d).join(dim_entity(spark, d), "entity_id").join(dim_team(spark, d), "team_id")
    status = F.expr(_STATUS)
    rows = rows.select(
        "period_id",
        (F.col("period_id") * 10).alias("meeting_key"),
        (F.col("period_id") * 100).alias("session_key"),
        "season",
        F.concat(F.lit("Round "), F.col("period_num").cast("string")).alias("period_name"),
        F.concat(F.lit(" "), F.initcap("entity_name"), F.lit(" ")).alias("full_name"),
        F.upper("team_name").alias("team_name"),
        F.when(status == "Finished", F.col("position").cast("double")).alias("position"),
        F.col("position").cast("string").alias("classified_position"),
        status.alias("status"),
        F.col("seed_position").cast("double").alias("grid_position"),
    )
    return rows.unionByName(rows)


@query(
    "g24_stage_placements",
    f"""WITH {FACT}, {DIMS} SELECT period_id, season, 'Round ' || period_num AS period_name,
CASE entity_name WHEN 'supplier#000000001' THEN 'number one' ELSE entity_name END AS entity, team_name AS team,
{_POSITION} AS finish_position, CAST(position AS VARCHAR) AS classified_position, {_STATUS} AS status,
CAST(seed_position AS DOUBLE) AS grid_position, CAST({_STATUS} = 'Did not start' AS INTEGER) AS dns,
CAST({_STATUS} = 'Retired' AS INTEGER) AS dnf, CAST({_STATUS} = 'Disqualified' AS INTEGER) AS dsq, 0 AS nc
FROM fact JOIN dim_entity USING (entity_id) JOIN dim_team USING (team_id)""",
)
def _(spark, d):
    return sg.stage_placements(_results(spark, d), {"supplier#000000001": "number one"})


@query(
    "g25_stage_qualifying",
    f"""WITH {FACT}, {DIMS} SELECT season, period_id, period_id * 10 AS meeting_key, period_id * 100 AS session_key,
entity_id AS entity_number, entity_name, entity_id, seed_position, period_num AS seed_laps, price AS q1_time,
CASE WHEN seed_position <= 10 THEN price - 1 END AS q2_time, NULL::DOUBLE AS q3_time, false AS dnf, false AS dns, false AS dsq
FROM fact JOIN dim_entity USING (entity_id)""".replace("price - 1", "round(price - 1, 4) + 0.0"),
)
def _(spark, d):
    rows = checkpointed(fact(spark, d))
    meeting, session = F.col("period_id") * 10, F.col("period_id") * 100
    raw = rows.select(
        F.col("seed_position").alias("position"),
        F.col("entity_id").alias("entity_number"),
        F.col("period_num").alias("number_of_laps"),
        *[F.lit(False).alias(c) for c in ("dnf", "dns", "dsq")],
        F.array("price", F.when(F.col("seed_position") <= 10, F.round(F.col("price") - 1, 4))).alias("duration"),
        meeting.alias("meeting_key"),
        session.alias("session_key"),
    )
    sessions = rows.select(session.alias("session_key"), F.lit("Qualifying").alias("session_type"))
    sprint = raw.withColumn("session_key", F.col("session_key") + 1)
    sessions = sessions.unionByName(sprint.select("session_key", F.lit("Race").alias("session_type")))
    named = rows.join(dim_entity(spark, d), "entity_id").select(
        meeting.alias("meeting_key"), F.col("entity_id").alias("entity_number"), F.upper("entity_name").alias("full_name")
    )
    periods = dim_period(spark, d).withColumn("meeting_key", F.col("period_id") * 10)
    out = sg.stage_qualifying(raw.unionByName(sprint), sessions, named.unionByName(named), periods, dim_entity(spark, d))
    return out.withColumn("entity_name", F.lower("entity_name"))


def _meetings(spark, d):
    p = dim_period(spark, d)
    iso = F.date_format(F.col("date_start"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = p.select(
        (F.col("period_id") * 10).alias("meeting_key"),
        F.col("period_name").alias("meeting_name"),
        F.when(F.col("period_num") == 2, "Winter TESTING").otherwise(F.col("period_name")).alias("meeting_official_name"),
        iso.alias("date_start"),
        F.when(F.col("period_num") != 5, iso).otherwise("unknown").alias("date_end"),
        "season",
    )
    return rows.unionByName(rows)


@query(
    "g26_stage_meetings",
    f"""WITH {PERIODS} SELECT period_id * 10 AS meeting_key, period_name AS meeting_name, CAST(date_start AS TIMESTAMP) AS date_start,
CASE WHEN period_num <> 5 THEN CAST(date_start AS TIMESTAMP) END AS date_end, season FROM dim_period WHERE period_num <> 2""",
)
def _(spark, d):
    return tidy(sg.stage_meetings(_meetings(spark, d)))


@query(
    "g26_build_dim_period",
    f"""WITH {PERIODS} SELECT period_id * 10 AS meeting_key, season, is_special,
row_number() OVER (ORDER BY season, period_num) AS period_id, row_number() OVER (PARTITION BY season ORDER BY period_num) AS period_num
FROM dim_period WHERE period_num <> 2""",
)
def _(spark, d):
    meetings = sg.stage_meetings(_meetings(spark, d))
    sessions = sg.stage_sessions(
        dim_period(spark, d).select(
            (F.col("period_id") * 100).alias("session_key"),
            (F.col("period_id") * 10).alias("meeting_key"),
            F.when(F.col("is_special"), "SPRINT Qualifying").otherwise("Race").alias("session_name"),
            F.lit("2024-01-01T00:00:00Z").alias("date_start"),
            F.lit(None).cast("string").alias("date_end"),
            "season",
        )
    )
    rows = sg.build_dim_period(meetings, sessions)
    rows = ky.assign_keys(rows, "meeting_key", ["season", "date_start", "meeting_key"], "period_id")
    rows = ky.number_within_season(rows, "season", ["date_start", "meeting_key"], "period_num")
    return rows.select("meeting_key", "season", "is_special", "period_id", "period_num")


@query(
    "g26_stage_sessions",
    """SELECT o_orderkey AS session_key, o_orderpriority AS session_name, o_orderdate AS date_start, NULL::TIMESTAMP AS date_end,
o_custkey AS meeting_key FROM orders""",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_key"),
        F.col("o_orderpriority").alias("session_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_start"),
        F.lit("soon").alias("date_end"),
        F.col("o_custkey").alias("meeting_key"),
        F.lit(1).alias("extra"),
    )
    return tidy(sg.stage_sessions(rows.unionByName(rows)))


@query(
    "g26_stage_entities",
    """SELECT DISTINCT o_custkey AS meeting_key, o_custkey * 10 AS session_key, lower(c_name) AS full_name,
min(c_nationkey) OVER (PARTITION BY o_custkey) AS entity_number, c_mktsegment AS team_name
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    people = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = read_table(spark, d, "orders").join(people, "o_custkey")
    rows = rows.select(
        F.col("o_custkey").alias("meeting_key"),
        (F.col("o_custkey") * 10).alias("session_key"),
        F.col("c_name").alias("full_name"),
        F.col("c_nationkey").alias("entity_number"),
        F.lit("X").alias("acronym"),
        F.col("c_mktsegment").alias("team_name"),
    )
    return sg.stage_entities(rows).drop("acronym")


@query(
    "g26_stage_teams",
    """SELECT DISTINCT year(o_orderdate)::INTEGER AS season, c_mktsegment AS team_name FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    people = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = read_table(spark, d, "orders").join(people, "o_custkey")
    return sg.stage_teams(
        rows.select(F.year("o_orderdate").alias("season"), F.col("c_mktsegment").alias("team_name"), "o_orderkey")
    )


@query(
    "g26_stage_long_measures",
    f"WITH {FACT0} SELECT entity_id, CAST(period_num AS VARCHAR) AS period, points, season FROM fact0",
)
def _(spark, d):
    months = list(range(1, 13))
    rows = base_fact(spark, d).withColumn("source_sheet", F.concat(F.col("season").cast("string"), F.lit("EntityPoints")))
    wide = rows.groupBy("entity_id", "source_sheet").pivot("period_num", months).agg(F.max("points"))
    long = wide.unpivot(["entity_id", "source_sheet"], [str(m) for m in months], "period", "points")
    return sg.stage_long_measures(long)


# ---------------------------------------------------------------- facts


@query(
    "g1_build_entity_fact",
    f"""WITH {FACT}, {DIMS} SELECT period_id, fact.season, fact.period_num, period_name, date_start, dim_period.is_special, entity_id,
entity_name, CAST(fact.season * 1000 + team_id AS BIGINT) AS team_id, team_name, price, points,
CASE WHEN position > 1 THEN position END AS finish_position, CASE WHEN position > 1 THEN {_STATUS} END AS status,
rating_before, rating_after - rating_before AS rating_delta, rating_after, seed_position, fact.period_num AS seed_laps
FROM fact JOIN dim_entity USING (entity_id) JOIN dim_team USING (team_id) JOIN dim_period USING (period_id)""",
)
def _(spark, d):
    named = fact(spark, d).join(dim_entity(spark, d), "entity_id").join(dim_team(spark, d), "team_id")
    named = named.withColumnRenamed("entity_name", "entity").withColumn("status", F.expr(_STATUS))
    named = checkpointed(named)
    placed = named.select(
        "period_id", "entity", F.upper("team_name").alias("team"), F.col("position").alias("finish_position"), "status"
    )
    later = placed.withColumns({"finish_position": F.col("finish_position") + 1, "status": F.lit(None).cast("string")})
    teams = named.select(
        "season", (F.col("season") * 1000 + F.col("team_id")).alias("team_id"), "team_name"
    ).distinct()
    return fa.build_entity_fact(
        named.select("season", "period_num", "entity", "points"),
        named.select("season", "period_num", "entity", "price"),
        dim_entity(spark, d),
        dim_period(spark, d),
        teams,
        placed.unionByName(later).filter("finish_position > 1").join(
            placed.filter("finish_position = 1").select("period_id", "entity"), ["period_id", "entity"], "left_anti"
        ),
        named.select(
            "period_id",
            "entity",
            "rating_before",
            (F.col("rating_after") - F.col("rating_before")).alias("rating_delta"),
            "rating_after",
        ),
        named.select("period_id", "entity_id", "seed_position", F.col("period_num").alias("seed_laps")),
        placed.filter("finish_position = 1").unionByName(later),
    )


@query(
    "g2_build_team_fact",
    f"""WITH {FACT0}, {DIMS}, tf AS (SELECT season, period_num, period_id, team_id, {rnd("sum(points)")} AS points,
{rnd("avg(price)")} AS price FROM fact0 GROUP BY ALL)
SELECT period_id, tf.season, tf.period_num, period_name, date_start, is_special, CAST(tf.season * 1000 + team_id AS BIGINT) AS team_id, team_name,
price, points FROM tf JOIN dim_team USING (team_id) JOIN dim_period USING (period_id)""",
)
def _(spark, d):
    rows = base_fact(spark, d).join(dim_team(spark, d), "team_id").groupBy("season", "period_num", "team_id", "team_name")
    rows = checkpointed(rows.agg(F.sum("points").alias("points"), F.avg("price").alias("price")))
    points = rows.select("season", "period_num", F.concat(F.lit(" "), F.upper("team_name")).alias("team"), "points")
    prices = rows.select("season", "period_num", F.col("team_name").alias("team"), "price")
    teams = rows.select("season", (F.col("season") * 1000 + F.col("team_id")).alias("team_id"), "team_name").distinct()
    return tidy(fa.build_team_fact(points, prices, dim_period(spark, d), teams))


@query(
    "g2_team_fact_by_deliveries",
    f"""WITH {FACT0}, {DIMS} SELECT season, period_num, team_name, {rnd("avg(price)")} AS price, {rnd("sum(points)")} AS points
FROM fact0 JOIN dim_team USING (team_id) GROUP BY ALL""",
)
def _(spark, d):
    """Raw team rows taken in by three deliveries, the last one a repeat: names and dates in, ids continued."""
    rows = base_fact(spark, d).join(dim_team(spark, d), "team_id").groupBy("season", "period_num", F.col("team_name").alias("team"))
    rows = checkpointed(rows.agg(F.sum("points").alias("points"), F.avg("price").alias("price")))
    meetings = checkpointed(dim_period(spark, d).select("season", "period_name", "date_start", "is_special"))
    cut = rows.agg(F.max("season")).first()[0]
    store = inc.Store(spark, shared_folder(spark, "store"))
    for part in (f"season < {cut}", f"season = {cut}", f"season = {cut}"):
        some = rows.where(part)
        prices, points = some.select("season", "period_num", "team", "price"), some.select("season", "period_num", "team", "points")
        store.deliver({"meetings": meetings.where(part), "team_points": points, "team_prices": prices})
    return tidy(store.built("team_fact").select("season", "period_num", "team_name", "price", "points"))


# ---------------------------------------------------------------- features

_E = "PARTITION BY entity_id ORDER BY period_id"
_G = "PARTITION BY season, period_id, team_id"
G3_CTE = f"""gap AS (SELECT f.*, p.date_start, CASE WHEN count(seed_position) OVER ({_G}) = 2
  THEN seed_position - (sum(seed_position) OVER ({_G}) - seed_position) END AS gap
  FROM fact f JOIN (SELECT period_id, date_start FROM dim_period) p USING (period_id)),
roll AS (SELECT *, price - lag(price) OVER ({_E}) AS chg,
  (price - lag(price) OVER ({_E})) / nullif(lag(price) OVER ({_E}), 0) AS chg_pct,
  avg(points) OVER ({_E} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p5,
  avg(points) OVER ({_E} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p3,
  avg(seed_position) OVER ({_E} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s5,
  avg(gap) OVER ({_E} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g5 FROM gap),
peer AS (SELECT *, sum(p5) OVER ({_G}) - p5 AS rest FROM roll),
features AS (SELECT season, period_id, date_start, CAST(is_special AS INTEGER) AS is_special, entity_id, team_id, price, points, rating_before,
  {rnd("coalesce(chg, 0)")} AS price_change, {rnd("coalesce(chg_pct, 0)")} AS price_change_pct,
  {rnd("coalesce(p5, 0)")} AS points_last_5_avg, {rnd("coalesce(p5 / nullif(price, 0), 0)")} AS ppm_last_5,
  {rnd("coalesce(s5, 20)")} AS seed_last_5_avg, {rnd("coalesce(g5, 0)")} AS seed_vs_partner_last_5,
  CASE WHEN chg > 0 THEN 1 ELSE 0 END AS price_increase, CASE WHEN chg < 0 THEN 1 ELSE 0 END AS price_decrease,
  {rnd("coalesce(p3 - p5, 0)")} AS momentum, {rnd("coalesce(rest, 0)")} AS partner_points_last_5,
  {rnd("coalesce(p5 - rest, 0)")} AS partner_delta_last_5 FROM peer)"""


def dated_fact(spark, d):
    return fact(spark, d).join(dim_period(spark, d).select("period_id", "date_start"), "period_id")


def entity_feature_table(spark, d):
    return fe.entity_features(checkpointed(dated_fact(spark, d)))


@query("g3_entity_features", f"WITH {FACT}, {DIMS}, {G3_CTE} SELECT * FROM features")
def _(spark, d):
    return tidy(entity_feature_table(spark, d))


_T = "PARTITION BY team_id ORDER BY period_id"
G4_CTE = f"""tf AS (SELECT season, period_num, period_id, team_id, sum(points) AS points, avg(price) AS price,
  bool_or(period_num % 4 = 0) AS is_special FROM fact0 GROUP BY ALL),
tl AS (SELECT *, lag(price) OVER ({_T}) AS pp, lag(points) OVER ({_T}) AS pt FROM tf),
tr AS (SELECT *, price - pp AS chg, (price - pp) / nullif(pp, 0) AS chg_pct,
  avg(pt) OVER ({_T} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p5,
  avg(pt) OVER ({_T} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p3 FROM tl),
team_features AS (SELECT tr.season, tr.period_id, date_start, CAST(tr.is_special AS INTEGER) AS is_special, team_id, {rnd("price")} AS price,
  {rnd("points")} AS points, {rnd("chg")} AS price_change, {rnd("chg_pct")} AS price_change_pct, {rnd("p5")} AS points_last_5_avg,
  {rnd("p3")} AS points_last_3_avg, {rnd("p5 / nullif(price, 0)")} AS ppm_last_5, {rnd("p3 / nullif(price, 0)")} AS ppm_last_3,
  {rnd("p3 - p5")} AS momentum, CASE WHEN chg > 0 THEN 1 ELSE 0 END AS price_increase,
  CASE WHEN chg < 0 THEN 1 ELSE 0 END AS price_decrease FROM tr JOIN dim_period USING (period_id))"""


def team_feature_table(spark, d):
    rows = base_fact(spark, d).groupBy("season", "period_num", "period_id", "team_id")
    rows = rows.agg(F.sum("points").alias("points"), F.avg("price").alias("price"))
    rows = rows.join(dim_period(spark, d).select("period_id", "date_start", "is_special"), "period_id")
    return fe.team_features(rows, key="team_id")


@query("g4_team_features", f"WITH {FACT0}, {DIMS}, {G4_CTE} SELECT * FROM team_features")
def _(spark, d):
    return tidy(team_feature_table(spark, d))


_TARGET = """target AS (SELECT CAST(max(season) + 1 AS INTEGER) AS season, 1 AS period_num,
  CAST((max(season) + 1) * 100 + 1 AS BIGINT) AS period_id, make_timestamp(max(season) + 1, 1, 1, 0, 0, 0) AS date_start, true AS is_special FROM fact0)"""


def _target(spark, d):
    nxt = base_fact(spark, d).agg((F.max("season") + 1).alias("season"))
    return nxt.select(
        "season",
        F.lit(1).alias("period_num"),
        (F.col("season") * 100 + 1).cast("long").alias("period_id"),
        day(F.col("season"), F.lit(1), 1).alias("date_start"),
        F.lit(True).alias("is_special"),
    )


_FEATS = ", ".join(f"h.{c}" for c in fe.ENTITY_FEATURES)


@query(
    "g5_scoring_frame_entity",
    f"""WITH {FACT}, {DIMS}, {G3_CTE}, {_TARGET},
h AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY period_id DESC) = 1),
le AS (SELECT entity_id, rating_after FROM fact QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY period_id DESC) = 1)
SELECT t.season, t.period_id, t.date_start, h.is_special, e.entity_id, h.team_id, s.s_acctbal AS price, NULL::DOUBLE AS points,
le.rating_after AS rating_before, {_FEATS} FROM target t CROSS JOIN supplier s JOIN dim_entity e ON lower(s.s_name) = e.entity_name
LEFT JOIN h ON h.entity_id = e.entity_id LEFT JOIN le ON le.entity_id = e.entity_id""",
)
def _(spark, d):
    rows = checkpointed(dated_fact(spark, d))
    target = _target(spark, d)
    season = target.select("season").scalar()
    prices = read_table(spark, d, "supplier").select(
        season.alias("season"), F.lit(1).alias("period_num"), F.lower("s_name").alias("entity"), F.col("s_acctbal").alias("price")
    )
    return tidy(fe.scoring_frame_entity(target, prices, dim_entity(spark, d), fe.entity_features(rows), rows))


_TFEATS = ", ".join(f"h.{c}" for c in fe.TEAM_FEATURES)


@query(
    "g6_scoring_frame_team",
    f"""WITH {FACT0}, {DIMS}, {G4_CTE}, {_TARGET},
h AS (SELECT * FROM team_features QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY period_id DESC) = 1)
SELECT t.season, t.period_id, t.date_start, 1 AS is_special, dt.team_id, CAST(n_regionkey AS DOUBLE) AS price, NULL::DOUBLE AS points, {_TFEATS}
FROM target t CROSS JOIN nation n JOIN dim_team dt ON lower(n.n_name) = dt.team_name LEFT JOIN h ON h.team_id = dt.team_id""",
)
def _(spark, d):
    target = _target(spark, d)
    season = target.select("season").scalar()
    prices = read_table(spark, d, "nation").select(
        season.alias("season"), F.lit(1).alias("period_num"), F.upper("n_name").alias("team"),
        F.col("n_regionkey").cast("double").alias("price"),
    )
    teams = dim_team(spark, d).withColumn("season", season)
    return tidy(fe.scoring_frame_team(target, prices, teams, team_feature_table(spark, d)))


def _in_steps(state, rows):
    """Build the earlier three fifths of the periods, then add the rest in two steps."""
    cuts = rows.agg(F.percentile_approx("period_id", [0.6, 0.8])).first()[0]
    state.extend(rows.filter(F.col("period_id") <= cuts[0]))
    state.extend(rows.filter((F.col("period_id") > cuts[0]) & (F.col("period_id") <= cuts[1])))
    state.extend(rows.filter(F.col("period_id") > cuts[1]))
    return state


def _entity_state(spark, d):
    rows = checkpointed(dated_fact(spark, d))
    return _in_steps(fs.FeatureState(spark, shared_folder(spark, "entity-state"), fs.ENTITY), rows)


def _team_state(spark, d):
    rows = base_fact(spark, d).groupBy("season", "period_num", "period_id", "team_id")
    rows = rows.agg(F.sum("points").alias("points"), F.avg("price").alias("price"))
    rows = checkpointed(rows.join(dim_period(spark, d).select("period_id", "date_start", "is_special"), "period_id"))
    return _in_steps(fs.FeatureState(spark, shared_folder(spark, "team-state"), fs.TEAM), rows)


@query("g3_entity_features_in_steps", ORACLE["g3_entity_features"])
def _(spark, d):
    return tidy(_entity_state(spark, d).features())


@query("g4_team_features_in_steps", ORACLE["g4_team_features"])
def _(spark, d):
    return tidy(_team_state(spark, d).features())


@query("g5_scoring_frame_entity_in_steps", ORACLE["g5_scoring_frame_entity"])
def _(spark, d):
    """From the latest rows of the state: no period is read again."""
    target, latest = _target(spark, d), _entity_state(spark, d).latest()
    prices = read_table(spark, d, "supplier").select(
        target.select("season").scalar().alias("season"), F.lit(1).alias("period_num"), F.lower("s_name").alias("entity"), F.col("s_acctbal").alias("price")
    )
    return tidy(fe.scoring_frame_entity(target, prices, dim_entity(spark, d), latest, latest))


@query("g6_scoring_frame_team_in_steps", ORACLE["g6_scoring_frame_team"])
def _(spark, d):
    target = _target(spark, d)
    season = target.select("season").scalar()
    prices = read_table(spark, d, "nation").select(
        season.alias("season"), F.lit(1).alias("period_num"), F.upper("n_name").alias("team"), F.col("n_regionkey").cast("double").alias("price")
    )
    return tidy(fe.scoring_frame_team(target, prices, dim_team(spark, d).withColumn("season", season), _team_state(spark, d).latest()))


@query(
    "g20_price_dynamics",
    f"""WITH {FACT0}, two AS (SELECT * REPLACE (round(price + 1e-9, 2) AS price, round(points + 1e-9, 2) AS points) FROM fact0),
h AS (SELECT *, lag(price) OVER ({_E}) AS pp, lead(price) OVER ({_E}) AS np,
count(points) OVER ({_E} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS fc,
avg(points) OVER ({_E} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS favg FROM two)
SELECT season, period_id, entity_id, team_id, {{}} fc AS form_count,
CASE WHEN price < 18.5 THEN 'below_18_5' ELSE 'above_18_5' END AS price_tier,
CASE WHEN price >= 34 THEN 1 ELSE 0 END AS at_price_ceiling, CASE WHEN price <= 3 THEN 1 ELSE 0 END AS at_price_floor
FROM h WHERE np IS NOT NULL AND fc = 3""".format(
        "".join(
            f"round({e} + 1e-9, 2) + 0.0 AS {n}, "
            for e, n in [
                ("price", "price"), ("pp", "prev_price"), ("np", "next_price"), ("np - price", "next_price_delta"),
                ("points", "points"), ("favg", "form_avg"), ("34 - price", "distance_from_ceiling"),
                ("price - 3", "distance_from_floor"),
            ]
        )
    ),
)
def _(spark, d):
    # two decimals in, so that no rounding of the result meets an exact half
    rows = base_fact(spark, d)
    return fe.price_dynamics(rows.withColumns({c: F.round(F.col(c) + 1e-9, 2) for c in ("price", "points")}))


@query(
    "g29_history_before",
    f"WITH {FACT0} SELECT entity_id, season, period_num, points FROM fact0 WHERE season < 1997 OR (season = 1997 AND period_num < 5)",
)
def _(spark, d):
    return fe.history_before(base_fact(spark, d), 1997, 5).select("entity_id", "season", "period_num", "points")


# ---------------------------------------------------------------- rating


def _raw_positions(spark, d):
    status = F.expr(_STATUS)
    return fact(spark, d).select(
        "pool_id",
        "season",
        "period_id",
        F.col("entity_id").alias("entity"),
        F.when(status == "Finished", F.col("position").cast("double")).alias("position"),
        (status == "Did not start").alias("dns"),
        (status == "Retired").alias("dnf"),
        (status == "Disqualified").alias("dsq"),
        F.lit(False).alias("nc"),
    )


_RESOLVED = f"""st AS (SELECT *, {_STATUS} AS status FROM fact),
mx AS (SELECT *, max(CASE WHEN status = 'Finished' THEN position END) OVER (PARTITION BY pool_id, season, period_id) AS m
  FROM st WHERE status <> 'Did not start'),
resolved AS (SELECT pool_id, season, period_id, entity_id AS entity, CAST(CASE WHEN status = 'Finished' THEN position
  WHEN status = 'Retired' THEN m + 1 ELSE m + 2 END AS DOUBLE) AS rating_position FROM mx
  WHERE m IS NOT NULL OR status = 'Finished')"""


@query("g7_resolve_positions", f"WITH {FACT}, {_RESOLVED} SELECT * FROM resolved")
def _(spark, d):
    rows = rt.resolve_positions(_raw_positions(spark, d), ["pool_id", "season", "period_id"])
    return rows.select("pool_id", "season", "period_id", "entity", "rating_position")


_SCORE = "CASE WHEN a.position < b.position THEN 1.0 WHEN a.position = b.position THEN 0.5 ELSE 0.0 END::DOUBLE"
_EXPECT = "1 / (1 + pow(10, (b.rating_before - a.rating_before) / 400))"


@query(
    "g8_matchup_totals",
    f"""WITH {FACT} SELECT a.pool_id, a.period_id, a.entity_id,
{rnd(f"coalesce(sum({_EXPECT}), 0)")} AS expected,
{rnd(f"coalesce(sum({_SCORE}) FILTER (b.entity_id IS NOT NULL), 0)")} AS actual,
{rnd(f"8 * (coalesce(sum({_SCORE}) FILTER (b.entity_id IS NOT NULL), 0) - coalesce(sum({_EXPECT}), 0))")} AS rating_delta
FROM fact a LEFT JOIN fact b ON a.pool_id = b.pool_id AND a.period_id = b.period_id AND a.entity_id <> b.entity_id GROUP BY ALL""",
)
def _(spark, d):
    rows = checkpointed(fact(spark, d).select("pool_id", "period_id", "entity_id", "position", "rating_before"))
    out = rt.matchup_totals(rows, ["pool_id", "period_id"], "entity_id", "position")
    return tidy(out.drop("position", "rating_before"))


@query("g8_matchup_totals_split", ORACLE["g8_matchup_totals"])
def _(spark, d):
    """The plan for groups too large for one task."""
    rows = fact(spark, d).select("pool_id", "period_id", "entity_id", "position", "rating_before")
    out = rt.matchup_totals(rows, ["pool_id", "period_id"], "entity_id", "position", period_rows=0)
    return tidy(out.drop("position", "rating_before"))


def _resolved(spark, d):
    rows = rt.resolve_positions(_raw_positions(spark, d), ["pool_id", "season", "period_id"])
    return rows.select("pool_id", "season", "period_id", "entity", "rating_position")


def rating_sql(ctes: str) -> str:
    """The rating as a recursive query over ``resolved``: one step per period, state in rows."""
    return f"""WITH RECURSIVE {ctes},
res AS (SELECT *, dense_rank() OVER (ORDER BY season, period_id) AS step,
  dense_rank() OVER (PARTITION BY pool_id ORDER BY season) - 1 AS chg FROM resolved),
r AS (
  SELECT 0::BIGINT AS step, pool_id, entity, 1500.0::DOUBLE AS rating, NULL::INTEGER AS last_season, 0::BIGINT AS seen,
    NULL::INTEGER AS season, NULL::BIGINT AS period_id, NULL::DOUBLE AS rating_position, NULL::DOUBLE AS before
  FROM (SELECT DISTINCT pool_id, entity FROM res)
  UNION ALL
  SELECT step + 1, pool_id, entity,
    CASE WHEN pos IS NULL THEN rating ELSE before + 8 * (
      list_sum(list_transform(all_pos, lambda x: CASE WHEN pos < x THEN 1.0 WHEN pos = x THEN 0.5 ELSE 0.0 END::DOUBLE)) - 0.5
      - (list_sum(list_transform(all_before, lambda x: 1 / (1 + pow(10, (x - before) / 400)))) - 0.5)) END,
    CASE WHEN pos IS NULL THEN last_season ELSE s END, CASE WHEN pos IS NULL THEN seen ELSE chg END,
    s, pid, pos, CASE WHEN pos IS NOT NULL THEN before END
  FROM (
    SELECT *, list(pos) FILTER (pos IS NOT NULL) OVER (PARTITION BY pool_id) AS all_pos,
      list(before) FILTER (pos IS NOT NULL) OVER (PARTITION BY pool_id) AS all_before
    FROM (
      SELECT r.step, r.pool_id, r.entity, r.rating, r.last_season, r.seen, n.season AS s, n.period_id AS pid,
        n.rating_position AS pos, n.chg,
        CASE WHEN r.last_season IS NULL THEN 1500.0 ELSE 1500 + pow(0.75, n.chg - r.seen)
          * pow(0.75, greatest(0, n.season - r.last_season - 1)) * (r.rating - 1500) END AS before
      FROM r LEFT JOIN res n ON n.pool_id = r.pool_id AND n.entity = r.entity AND n.step = r.step + 1
      WHERE r.step < (SELECT max(step) FROM res)))
)
SELECT pool_id, season, period_id, entity, rating_position, round(before, 4) + 0.0 AS rating_before,
round(rating - before, 4) + 0.0 AS rating_delta, round(rating, 4) + 0.0 AS rating_after FROM r WHERE rating_position IS NOT NULL"""


@query("g9_sequential_rating", rating_sql(f"{FACT}, {_RESOLVED}"))
def _(spark, d):
    out = rt.sequential_rating(checkpointed(_resolved(spark, d)), "pool_id")
    return out.withColumns({c: F.round(c, 4) for c in rt.RATING_COLUMNS})


@query(
    "g10_expand_rating",
    f"""WITH {FACT}, rated AS (SELECT * FROM fact WHERE seed_position IS NOT NULL),
j AS (SELECT f.entity_id, f.period_id, r.rating_before AS b, r.rating_after AS a FROM fact f LEFT JOIN rated r USING (entity_id, period_id)),
c AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY period_id ROWS UNBOUNDED PRECEDING) AS carried FROM j)
SELECT entity_id, period_id, coalesce(b, carried, 1500) AS rating_before, coalesce(a - b, 0) AS rating_delta,
coalesce(a, b, carried, 1500) AS rating_after FROM c""",
)
def _(spark, d):
    rows = checkpointed(fact(spark, d).select("entity_id", "period_id", "seed_position", "rating_before", "rating_after"))
    rated = rows.filter("seed_position IS NOT NULL").withColumn("rating_delta", F.col("rating_after") - F.col("rating_before"))
    return rt.expand_rating(rated, rows.select("entity_id", "period_id"))


# ---------------------------------------------------------------- outcomes

PRED = """pred AS (SELECT *, avg(points) OVER (PARTITION BY entity_id ORDER BY period_id
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS predicted_points FROM fact0)"""
_DRAW = "CASE WHEN predicted_points < 20 THEN '00_20' ELSE '20_plus' END"
RES = f"""res AS (SELECT *, points - predicted_points AS residual, {_DRAW} AS prediction_bucket FROM pred WHERE predicted_points IS NOT NULL)"""


def predictions(spark, d):
    return wn.trailing_mean(base_fact(spark, d), "entity_id", "period_id", "points", 5, "predicted_points", None)


def _residual_rows(spark, d):
    rows = predictions(spark, d)
    # tied residuals must sort alike in both engines
    pred = rows.drop("points").withColumn("predicted_points", F.round(F.col("predicted_points") + 1e-9, 6))
    return oc.residuals(pred, rows.select("period_id", "entity_id", "points"))


@query(
    "g11_residuals",
    f"""WITH {FACT0}, {PRED}, {RES} SELECT period_id, entity_id, {rnd("predicted_points")} AS predicted_points, points AS actual_points,
{rnd("residual")} AS residual, {rnd("abs(residual)")} AS abs_residual, prediction_bucket, 'm' || season AS model_name FROM res""",
)
def _(spark, d):
    rows = predictions(spark, d)
    runs = base_fact(spark, d).select(F.col("season").alias("prediction_run_id")).distinct()
    runs = runs.withColumn("model_name", F.concat(F.lit("m"), F.col("prediction_run_id").cast("string")))
    pred = rows.withColumn("prediction_run_id", F.col("season")).drop("points")
    out = oc.residuals(pred, rows.select("period_id", "entity_id", "points"), runs)
    cols = ["period_id", "entity_id", "predicted_points", "actual_points", "residual", "abs_residual", "prediction_bucket", "model_name"]
    return tidy(out.select(*cols))


_QS = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def _stats_sql(c: str) -> str:
    return (
        f"count({c}) AS n, {rnd(f'avg({c})')} AS mean_{c}, {rnd(f'stddev_samp({c})')} AS std_{c}, "
        + ", ".join(f"{rnd(f'quantile_cont({c}, {q})')} AS {n}" for n, q in _QS.items())
    )


@query(
    "g12_residual_bucket_stats",
    f"WITH {FACT0}, {PRED}, {RES} SELECT prediction_bucket, {_stats_sql('residual')} FROM res GROUP BY prediction_bucket",
)
def _(spark, d):
    rows = predictions(spark, d)
    out = oc.residuals(rows.drop("points"), rows.select("period_id", "entity_id", "points"))
    return tidy(oc.residual_bucket_stats(out))


# Draws per score: fewer where every draw is a row of the result. Summaries use the operator's default.
N_DRAWS, N_SIMS, SEED = 40, 10_000, 42
RES6 = f"""res6 AS (SELECT *, points - rp AS residual, CASE WHEN rp < 20 THEN '00_20' ELSE '20_plus' END AS prediction_bucket
  FROM (SELECT *, {rnd("predicted_points")} AS rp FROM pred WHERE predicted_points IS NOT NULL))"""
def sims_sql(n_sims: int) -> str:
    return f"""pool AS (SELECT prediction_bucket, residual AS sampled_residual,
  row_number() OVER (PARTITION BY prediction_bucket ORDER BY residual, period_id, entity_id) - 1 AS idx,
  count(*) OVER (PARTITION BY prediction_bucket) AS size FROM res6),
sizes AS (SELECT prediction_bucket, count(*) AS size FROM res6 GROUP BY 1),
k AS (SELECT r.period_id, r.entity_id, r.team_id, r.price, r.rp AS predicted_points, r.prediction_bucket, s.size, sim,
  (r.entity_id * 613 + r.period_id) % 2147483647 AS key
  FROM res6 r JOIN sizes s USING (prediction_bucket), (SELECT unnest(range(0, {n_sims})) AS sim)),
a0 AS (SELECT *, (sim * 7919 + key * 104729 + {SEED * 1299709}) % 2147483647 AS x,
  (sim * 15485863 + key * 32452843 + {SEED * 49979687 + 1}) % 2147483647 AS y FROM k),
a1 AS (SELECT *, (x * x % 2147483647 * x + key * 31 + sim) % 2147483647 AS a, (y * y % 2147483647 * y + key + sim * 17) % 2147483647 AS b FROM a0),
sims AS (SELECT a1.*, p.sampled_residual, predicted_points + p.sampled_residual AS simulated_points FROM a1
  JOIN pool p ON p.prediction_bucket = a1.prediction_bucket AND p.idx = (a * 2147483647 + b) % a1.size)"""


def _drawn_from(spark, d):
    """Scores and residuals of all predictions."""
    rows = checkpointed(_residual_rows(spark, d))
    return rows.select(*oc.OUTCOME_KEYS), rows


def simulations(spark, d, n_sims, **plan):
    return oc.bootstrap_outcomes(*_drawn_from(spark, d), n_sims, SEED, **plan)


@query(
    "g13_bootstrap_outcomes",
    f"""WITH {FACT0}, {PRED}, {RES6}, {sims_sql(N_DRAWS)} SELECT period_id, entity_id, sim AS simulation_id, {rnd("sampled_residual")} AS sampled_residual,
{rnd("simulated_points")} AS simulated_points FROM sims""",
)
def _(spark, d):
    cols = ["period_id", "entity_id", "simulation_id", "sampled_residual", "simulated_points"]
    return tidy(simulations(spark, d, N_DRAWS).select(*cols))


@query("g13_bootstrap_outcomes_split", ORACLE["g13_bootstrap_outcomes"])
def _(spark, d):
    """The plan for pools too large for one task."""
    cols = ["period_id", "entity_id", "simulation_id", "sampled_residual", "simulated_points"]
    return tidy(simulations(spark, d, N_DRAWS, max_group_rows=0).select(*cols))


def _draw_stats_sql(c: str, keys: str, source: str) -> str:
    """All statistics from one sorted list per group, so that its values are held once."""
    return f"""stats AS (SELECT {keys}, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
  quantile_cont({c}, [{", ".join(map(str, _QS.values()))}]) AS qs FROM {source} GROUP BY {keys}),
named AS (SELECT * EXCLUDE (qs, mean, std), mean AS mean_{c}, std AS std_{c}, {", ".join(f"qs[{k}] AS {n}" for k, n in enumerate(_QS, 1))} FROM stats)"""


def _named_sql(c: str) -> str:
    return "n, " + ", ".join(f"{rnd(x)} AS {x}" for x in (f"mean_{c}", f"std_{c}", *_QS))


_OUTCOME = ", ".join(oc.OUTCOME_KEYS)


@query(
    "g14_summarize_outcomes",
    f"""WITH {FACT0}, {PRED}, {RES6}, {sims_sql(N_SIMS)}, {_draw_stats_sql("simulated_points", _OUTCOME, "sims")}
SELECT {_OUTCOME}, {_named_sql("simulated_points")}, {rnd("mean_simulated_points / nullif(price, 0)")} AS mean_per_price,
{rnd("p90 / nullif(price, 0)")} AS p90_per_price, {rnd("p90 - p10")} AS risk_range, {rnd("mean_simulated_points - p10")} AS downside_gap FROM named""",
)
def _(spark, d):
    return tidy(dw.outcome_summaries(*_drawn_from(spark, d), N_SIMS, SEED))


@query(
    "g15_selection_outcomes",
    f"""WITH {FACT0}, {PRED}, {RES6}, {sims_sql(N_SIMS)},
sel AS (SELECT 'team ' || team_id AS profile, period_id, entity_id FROM fact0),
tot AS (SELECT profile, s.period_id, sim, sum(simulated_points) AS selection_points FROM sims s JOIN sel USING (period_id, entity_id) GROUP BY ALL),
{_draw_stats_sql("selection_points", "profile, period_id", "tot")}
SELECT profile, period_id, {_named_sql("selection_points")} FROM named""",
)
def _(spark, d):
    members = base_fact(spark, d).select(
        F.concat(F.lit("team "), F.col("team_id").cast("string")).alias("profile"), "period_id", "entity_id"
    )
    return tidy(dw.selection_summaries(*_drawn_from(spark, d), members, n_sims=N_SIMS, seed=SEED))


@query(
    "g21_prediction_scorecard",
    f"""WITH {FACT0}, {DIMS}, {PRED}, tf AS (SELECT season, period_num, period_id, team_id, sum(points) AS points FROM fact0 GROUP BY ALL),
tp AS (SELECT *, avg(points) OVER (PARTITION BY team_id ORDER BY period_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS predicted_points FROM tf),
u AS (SELECT season, period_num, upper(entity_name) AS asset_name, predicted_points, points, 'entity' AS asset_type FROM pred JOIN dim_entity USING (entity_id)
UNION ALL SELECT season, period_num, upper(team_name), predicted_points, points, 'team' FROM tp JOIN dim_team USING (team_id))
SELECT season, period_num, asset_name, asset_type, {rnd("predicted_points")} AS predicted_points, {rnd("points")} AS points,
{rnd("abs(points - predicted_points)")} AS absolute_error FROM u""",
)
def _(spark, d):
    keys = ["season", "period_num", "asset_name"]
    ent = predictions(spark, d).join(dim_entity(spark, d), "entity_id").withColumn("asset_name", F.upper("entity_name"))
    rows = base_fact(spark, d).groupBy("season", "period_num", "period_id", "team_id").agg(F.sum("points").alias("points"))
    team = wn.trailing_mean(rows, "team_id", "period_id", "points", 5, "predicted_points", None)
    team = team.join(dim_team(spark, d), "team_id").withColumn("asset_name", F.upper("team_name"))
    pred = [x.select(*keys, "predicted_points").withColumn("asset_name", F.lower("asset_name")) for x in (ent, team)]
    return tidy(oc.prediction_scorecard(*pred, ent.select(*keys, "points"), team.select(*keys, "points")))


@query(
    "g28_outlier_drilldown",
    f"""WITH {FACT}, {DIMS}, {PRED} SELECT f.entity_id, f.period_id, e.entity_name, p.period_name, f.position, f.seed_position,
{rnd("r.points - r.predicted_points")} AS residual FROM pred r JOIN fact f USING (entity_id, period_id) JOIN dim_entity e USING (entity_id)
JOIN dim_period p USING (period_id) WHERE abs(r.points - r.predicted_points) >= 15""",
)
def _(spark, d):
    rows = predictions(spark, d)
    res = oc.residuals(rows.drop("points"), rows.select("period_id", "entity_id", "points"))
    out = oc.outlier_drilldown(res, fact(spark, d), dim_entity(spark, d), dim_period(spark, d), 15)
    return tidy(out.select("entity_id", "period_id", "entity_name", "period_name", "position", "seed_position", "residual"))


@query(
    "g23_source_name_reconciliation",
    f"""WITH {FACT}, {DIMS}, n AS (SELECT f.*, entity_name FROM fact f JOIN dim_entity USING (entity_id)),
u AS (SELECT season, period_num, 'points' AS source, entity_name FROM n WHERE points > 10
UNION ALL SELECT season, period_num, 'price', entity_name FROM n WHERE price > 20
UNION ALL SELECT season, period_num, 'placement', entity_name FROM n WHERE position > 2
UNION ALL SELECT season, period_num, 'rating', entity_name FROM n WHERE seed_position IS NOT NULL)
SELECT season, period_num, 0::BIGINT AS part, {{}} FROM u GROUP BY season, period_num""".format(
        ", ".join(
            f"string_agg(DISTINCT CASE WHEN source = '{s}' THEN entity_name END, ', ' ORDER BY CASE WHEN source = '{s}' THEN entity_name END) AS {s}_names"
            for s in ("points", "price", "placement", "rating")
        )
    ),
)
def _(spark, d):
    rows = fact(spark, d).join(dim_entity(spark, d), "entity_id")
    rows = rows.withColumn("name", F.concat(F.lit(" "), F.upper("entity_name")))
    pick = lambda cond: rows.filter(cond).select("season", "period_num", "name")
    sources = {
        "points": pick("points > 10"),
        "price": pick("price > 20"),
        "placement": pick("position > 2"),
        "rating": pick("seed_position IS NOT NULL"),
    }
    return source_name_reconciliation(sources, ["season", "period_num"], "name")


@query(
    "g23_unresolved_names",
    """SELECT lower(c_name) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(spark, d):
    people = read_table(spark, d, "customer").withColumn("name", F.concat(F.lit(" "), F.upper("c_name")))
    pending = read_table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return unresolved_names(people, people.join(pending, "c_custkey", "left_semi"), "name", "c_name")
