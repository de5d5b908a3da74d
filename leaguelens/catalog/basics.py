"""Queries for sources, projections, joins, aggregates, windows, sorts, sets and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaguelens.catalog.fixture import (
    DIMS,
    FACT,
    FACT0,
    PERIODS,
    base_fact,
    dim_entity,
    dim_period,
    dim_team,
    fact,
)
from leaguelens.catalog.registry import ORACLE, query, rnd, tidy
from leaguelens.functions import scalars as fx
from leaguelens.operators import aggregates as ag
from leaguelens.operators import joins as jn
from leaguelens.operators import ordering as od
from leaguelens.operators import reshape as rs
from leaguelens.operators import sets as st
from leaguelens.operators import windows as wn
from leaguelens.operators.common import number_rows
from leaguelens.session import shared_folder
from leaguelens.sources import tables as tb
from leaguelens.sources.key_index import KeyIndex
from leaguelens.sources.tables import read_table

# ---------------------------------------------------------------- sources


@query("s1_read_table", "SELECT * FROM orders")
def _(spark, d):
    return tidy(read_table(spark, d, "orders"))


@query("s7_append_new_only", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    """All orders after the pending ones are appended, twice, to a table of the others, by the index of its keys."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = shared_folder(spark, "append")
    orders.filter("o_orderstatus <> 'P'").write.parquet(path)
    index = KeyIndex(path, orders.schema, "o_orderkey")
    index.append(orders)
    index.append(orders)
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "s8_replace_slice",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE NOT coalesce(o_orderpriority = '1-URGENT', false)
UNION ALL SELECT o_orderkey, 'X', 0.0 FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders")
    patch = orders.filter("o_orderpriority = '1-URGENT'").withColumns(
        {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)}
    )
    out = tb.replace_slice(orders, patch, "o_orderpriority = '1-URGENT'")
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s8_replace_slice_in_place", ORACLE["s8_replace_slice"])
def _(spark, d):
    """The urgent orders of a table stored by priority are replaced on disk."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = shared_folder(spark, "orders")
    tb.overwrite_table(orders, path, "o_orderpriority")
    patch = orders.filter("o_orderpriority = '1-URGENT'").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    tb.replace_partitions(patch, path, "o_orderpriority")
    return spark.read.schema(orders.schema).parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


_ALL = {
    "region": 2, "nation": 3, "supplier": 4, "customer": 5, "part": 6, "orders": 6,
    "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
    "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(
    "s11_catalog_summary",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
        f"{n}::BIGINT AS n_columns, '{tb.SCHEMAS[t]}' AS column_types"
        for t, n in _ALL.items()
    ),
)
def _(spark, d):
    return tb.catalog_summary(spark, d)


def _profile_sql(table: str, numeric: list[str], other: list[str]) -> str:
    out = []
    for c in numeric:
        out.append(
            f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
            f"count({c}) AS n_value, {rnd(f'min({c})::DOUBLE')} AS min_value, "
            f"{rnd(f'max({c})::DOUBLE')} AS max_value, {rnd(f'avg({c}::DOUBLE)')} AS mean_value, "
            f"count(*) FILTER (isinf({c}::DOUBLE)) AS n_inf, {rnd(f'skewness({c}::DOUBLE)')} AS skew FROM {table}"
        )
    for c in other:
        out.append(
            f"SELECT '{c}', count(*), count(*) - count({c}), count({c}), NULL, NULL, NULL, NULL, NULL FROM {table}"
        )
    return " UNION ALL ".join(out)


@query(
    "s12_column_profile",
    _profile_sql(
        "events", ["event_id", "user_id", "value"], ["ts", "event_type", "props"]
    ),
)
def _(spark, d):
    return tidy(tb.column_profile(read_table(spark, d, "events")))


# ---------------------------------------------------------------- projections


@query("p1_project", "SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer")
def _(spark, d):
    return rs.project(
        read_table(spark, d, "customer"),
        ["c_custkey", "not_there", "c_mktsegment"],
        {"c_custkey": "customer_id", "c_mktsegment": "segment"},
    )


@query(
    "p2_where",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 250000",
)
def _(spark, d):
    rows = rs.where(
        read_table(spark, d, "orders"),
        "o_orderdate >= :lo AND o_orderdate < :hi AND o_totalprice > :price",
        lo="1997-01-01",
        hi="1998-01-01",
        price=250000,
    )
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "p3_drop_nulls",
    f"WITH {FACT} SELECT entity_id, period_id, seed_position FROM fact WHERE seed_position IS NOT NULL",
)
def _(spark, d):
    rows = fact(spark, d).select("entity_id", "period_id", "seed_position")
    return rs.drop_nulls(rows, "seed_position")


@query(
    "p4_where_in",
    "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_brand NOT IN ('Brand#2', 'Brand#3')",
)
def _(spark, d):
    rows = rs.where_in(read_table(spark, d, "part"), "p_type", ["ECONOMY", "STANDARD"])
    return rs.where_in(rows, "p_brand", ["Brand#2", "Brand#3"], negate=True).select("p_partkey", "p_type")


@query(
    "p5_where_in_subquery",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _(spark, d):
    items = read_table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    repeated = items.groupBy(*keys).count().filter("count > 1")
    return rs.where_in_subquery(items, keys, repeated).select(*keys, "l_quantity")


@query(
    "p6_where_scalar",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rs.where_scalar(orders, "o_orderdate", orders.agg(F.max("o_orderdate")))


@query(
    "p7_where_like",
    "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)RING|widget')",
)
def _(spark, d):
    rows = rs.where_like(read_table(spark, d, "part"), "p_name", "RING|widget", negate=True)
    return rows.select("p_partkey", "p_name")


_MONTHS = list(range(1, 13))
_WIDE_COLS = ", ".join(f"max(CASE WHEN period_num = {m} THEN points END) AS \"{m}\"" for m in _MONTHS)


def _wide(spark, d):
    rows = base_fact(spark, d).withColumn("row_id", F.concat_ws("-", "entity_id", "season"))
    return rows.groupBy("row_id").pivot("period_num", _MONTHS).agg(F.max("points"))


@query(
    "p8_unpivot_sheet",
    f"""WITH {FACT0}, grid AS (SELECT DISTINCT entity_id, season FROM fact0),
m AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS period_num)
SELECT g.entity_id || '-' || g.season AS row_id, CAST(m.period_num AS VARCHAR) AS period,
  f.points, 'points' AS source_sheet
FROM grid g CROSS JOIN m LEFT JOIN fact0 f
  ON f.entity_id = g.entity_id AND f.season = g.season AND f.period_num = m.period_num""",
)
def _(spark, d):
    return rs.unpivot_sheet(_wide(spark, d), "row_id", "period", "points", "points")


@query(
    "p9_standardize_headers",
    f"""WITH {FACT0} SELECT entity_id || '-' || season AS entity, {_WIDE_COLS} FROM fact0 GROUP BY entity_id, season""",
)
def _(spark, d):
    wide = _wide(spark, d)
    sheet = wide.toDF("Unnamed: 0", *[f" {m}.0 " for m in _MONTHS])
    sheet = sheet.withColumn("Unnamed: 13", F.lit(None).cast("double"))
    return rs.standardize_headers(sheet, "entity")


@query(
    "p10_pivot_fill",
    """SELECT o_custkey, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS F,
coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS O,
coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_custkey""".replace(
        "coalesce(sum(o_totalprice)", "round(1e-9 + coalesce(sum(o_totalprice)"
    ).replace(", 0) AS", ", 0), 6) AS"),
)
def _(spark, d):
    rows = rs.pivot_fill(
        read_table(spark, d, "orders"), "o_custkey", "o_orderstatus", F.sum("o_totalprice"), ["F", "O", "P"]
    )
    return tidy(rows)


BANDS = ([0, 5, 10, 15, 20], ["< 0", "0-5", "5-10", "10-15", "15-20", "20+"])
BAND_SQL = """CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0 THEN '< 0' WHEN {c} < 5 THEN '0-5' WHEN {c} < 10 THEN '5-10'
WHEN {c} < 15 THEN '10-15' WHEN {c} < 20 THEN '15-20' ELSE '20+' END"""


@query(
    "p11_bucketize",
    f"WITH {FACT0} SELECT entity_id, period_id, {BAND_SQL.format(c='points')} AS band FROM fact0",
)
def _(spark, d):
    return base_fact(spark, d).select(
        "entity_id", "period_id", rs.bucketize(F.col("points"), *BANDS).alias("band")
    )


@query(
    "p12_sign_flags",
    f"""WITH {FACT0}, c AS (SELECT entity_id, period_id,
price - lag(price) OVER (PARTITION BY entity_id ORDER BY period_id) AS x FROM fact0)
SELECT entity_id, period_id, CASE WHEN x > 0 THEN 1 ELSE 0 END AS increase,
CASE WHEN x < 0 THEN 1 ELSE 0 END AS decrease FROM c""",
)
def _(spark, d):
    rows = wn.change_and_pct(base_fact(spark, d), "entity_id", "period_id", "price", None)
    return rs.sign_flags(rows, "price_change").select("entity_id", "period_id", "increase", "decrease")


@query(
    "p13_canonicalize",
    """SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'top' WHEN '2-high' THEN 'top'
ELSE lower(trim(o_orderpriority)) END AS o_orderpriority FROM orders""",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rs.canonicalize(rows, "o_orderpriority", {"1-urgent": "top", "2-high": "top"})


@query(
    "p14_status_flags",
    """SELECT event_id, CAST(event_type IN ('error') AS INTEGER) AS failed,
CAST(event_type IN ('click', 'view') AS INTEGER) AS seen FROM events""",
)
def _(spark, d):
    rows = read_table(spark, d, "events").select("event_id", "event_type")
    return rs.status_flags(rows, "event_type", {"failed": ["error"], "seen": ["click", "view"]}).drop("event_type")


@query("p15_resolve_column", "SELECT s_suppkey AS entity_id, s_acctbal FROM supplier")
def _(spark, d):
    rows = rs.resolve_column(read_table(spark, d, "supplier"), ["driver_id", "s_suppkey"], "entity_id")
    return rows.select("entity_id", "s_acctbal")


@query(
    "p16_shrink_to_mean",
    f"""WITH {FACT0} SELECT entity_id, period_id,
{rnd("0.8 * points + 0.2 * avg(points) OVER (PARTITION BY pool_id, period_id)")} AS points FROM fact0""",
)
def _(spark, d):
    rows = rs.shrink_to_mean(base_fact(spark, d), "points", ["pool_id", "period_id"])
    return tidy(rows.select("entity_id", "period_id", "points"))


@query("p17_clip_low", "SELECT s_suppkey, greatest(s_acctbal, 0) AS s_acctbal FROM supplier")
def _(spark, d):
    return rs.clip_low(read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


# ---------------------------------------------------------------- joins


@query(
    "j1_join_inner",
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    customers = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = jn.join_inner(read_table(spark, d, "orders"), customers, "o_custkey")
    return rows.select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "j2_star_join",
    f"""WITH {FACT0}, {DIMS} SELECT f.entity_id, f.period_id, e.entity_name, t.team_name, p.period_name, f.points
FROM fact0 f LEFT JOIN dim_entity e USING (entity_id) LEFT JOIN dim_team t USING (team_id)
LEFT JOIN dim_period p USING (period_id)""",
)
def _(spark, d):
    rows = jn.star_join(
        base_fact(spark, d),
        [
            (dim_entity(spark, d), "entity_id"),
            (dim_team(spark, d), "team_id"),
            (dim_period(spark, d).select("period_id", "period_name"), "period_id"),
        ],
    )
    return rows.select("entity_id", "period_id", "entity_name", "team_name", "period_name", "points")


@query(
    "j3_join_left",
    f"""WITH {FACT0}, nxt AS (SELECT entity_id, season + 1 AS season, period_num, points AS last_year FROM fact0)
SELECT f.entity_id, f.season, f.period_num, f.points, n.last_year FROM fact0 f
LEFT JOIN nxt n ON f.entity_id = n.entity_id AND f.season = n.season AND f.period_num = n.period_num""",
)
def _(spark, d):
    rows = base_fact(spark, d).select("entity_id", "season", "period_num", "points")
    earlier = rows.select(
        "entity_id", (F.col("season") + 1).alias("season"), "period_num", F.col("points").alias("last_year")
    )
    return jn.join_left(rows, earlier, ["entity_id", "season", "period_num"])


@query(
    "j4_join_normalized",
    """WITH a AS (SELECT s_suppkey, '  ' || upper(n_name) || ' ' AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.s_suppkey, n.n_nationkey FROM a LEFT JOIN nation n ON lower(trim(a.place)) = lower(trim(n.n_name))""",
)
def _(spark, d):
    nations = read_table(spark, d, "nation")
    left = (
        read_table(spark, d, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("place"))
    )
    return jn.join_normalized(left, nations, {"place": "n_name"}).select("s_suppkey", "n_nationkey")


@query(
    "j5_join_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def _(spark, d):
    pending = read_table(spark, d, "orders").filter("o_orderstatus = 'P'")
    orders = pending.select(F.col("o_custkey").alias("c_custkey"))
    return jn.join_anti(read_table(spark, d, "customer"), orders, "c_custkey").select("c_custkey", "c_name")


@query(
    "j6_join_semi",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").filter("o_orderstatus = 'P'")
    ids = orders.select(F.col("o_custkey").alias("c_custkey"))
    return jn.join_semi(read_table(spark, d, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query(
    "j7_join_grain_safe",
    """SELECT c_custkey, o.n_orders, o.last_order FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return jn.join_grain_safe(
        read_table(spark, d, "customer").select("c_custkey"),
        orders,
        "c_custkey",
        {"n_orders": F.count(F.lit(1)), "last_order": F.max("o_orderdate")},
    )


@query(
    "j8_pair_with_leader",
    f"""WITH {FACT} SELECT f.pool_id, f.period_id, f.entity_id, f.points, l.entity_id AS entity_id_b, l.points AS points_b
FROM fact f JOIN fact l ON f.pool_id = l.pool_id AND f.period_id = l.period_id AND l.position = 1
WHERE f.entity_id <> l.entity_id""",
)
def _(spark, d):
    cols = ["pool_id", "period_id", "entity_id", "points"]
    rows = base_fact(spark, d).select(*cols)
    top = F.max_by(F.struct("entity_id", "points"), F.struct("points", -F.col("entity_id")))
    leaders = rows.groupBy("pool_id", "period_id").agg(top.alias("t")).select("pool_id", "period_id", "t.*")
    return jn.pair_with(rows, ["pool_id", "period_id"], "entity_id", leaders)


def _spine(spark, d):
    """Every entity at every period it could have had: its months come as rows, not by a cross join."""
    months = F.array(*[F.lit(m) for m in _MONTHS])
    seasons = base_fact(spark, d).select("entity_id", "season").distinct()
    return seasons.select(
        "entity_id", F.explode(F.transform(months, lambda m: (F.col("season") * 100 + m).cast("long"))).alias("period_id")
    )


_SPINE_SQL = """spine AS (SELECT entity_id, CAST(season * 100 + unnest(range(1, 13)) AS BIGINT) AS period_id
FROM (SELECT DISTINCT entity_id, season FROM fact0))"""


@query(
    "j9_asof_carry",
    f"""WITH {FACT0}, {_SPINE_SQL} SELECT s.entity_id, s.period_id, coalesce(f.points, 1500.0) AS points
FROM spine s ASOF LEFT JOIN fact0 f ON s.entity_id = f.entity_id AND s.period_id >= f.period_id""",
)
def _(spark, d):
    obs = base_fact(spark, d).select("entity_id", F.col("period_id").alias("seen"), "points")
    # one row per (entity, month): the grain bounds the key
    return jn.asof_carry(
        _spine(spark, d), obs, "entity_id", "period_id", "seen", "points", {"points": 1500.0}, max_group_rows=None
    )


@query(
    "j10_join_one_to_one",
    f"""WITH {FACT0} SELECT s_suppkey, s_name, m.best FROM supplier
JOIN (SELECT entity_id, max(points) AS best FROM fact0 GROUP BY entity_id) m ON m.entity_id = s_suppkey""",
)
def _(spark, d):
    best = base_fact(spark, d).groupBy(F.col("entity_id").alias("s_suppkey")).agg(F.max("points").alias("best"))
    return jn.join_one_to_one(read_table(spark, d, "supplier").select("s_suppkey", "s_name"), best, "s_suppkey")


@query(
    "j11_lookup_first",
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v) AS value FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""",
)
def _(spark, d):
    def best(status):
        rows = read_table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
        return rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))

    people = read_table(spark, d, "customer").select("c_custkey")
    return jn.lookup_first(people, [best("P"), best("F")], "c_custkey", "value")


# ---------------------------------------------------------------- aggregates


@query(
    "a1_group_agg",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n_rows, {rnd("sum(l_quantity)")} AS sum_qty,
{rnd("avg(l_extendedprice)")} AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax
FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    return tidy(
        ag.group_agg(
            read_table(spark, d, "lineitem"),
            ["l_returnflag", "l_linestatus"],
            {
                "n_rows": F.count(F.lit(1)),
                "sum_qty": F.sum("l_quantity"),
                "avg_price": F.avg("l_extendedprice"),
                "min_disc": F.min("l_discount"),
                "max_tax": F.max("l_tax"),
            },
        )
    )


@query(
    "a2_group_distinct",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_orderkey) AS n_l_orderkey
FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, d):
    return ag.group_distinct(read_table(spark, d, "lineitem"), "l_suppkey", ["l_partkey", "l_orderkey"])


@query(
    "a3_group_having",
    "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
def _(spark, d):
    return ag.group_having(
        read_table(spark, d, "orders"), "o_custkey", {"n_orders": F.count(F.lit(1))}, "n_orders > 12"
    )


@query(
    "a4_count_if",
    """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS big
FROM events GROUP BY user_id""",
)
def _(spark, d):
    return ag.count_if(
        read_table(spark, d, "events"),
        "user_id",
        {"errors": F.col("event_type") == "error", "big": F.col("value") > 20},
    )


@query(
    "a5_any_true",
    "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    return ag.any_true(rows, "o_custkey", "urgent")


@query(
    "a6_first_non_null",
    f"""WITH {FACT} SELECT entity_id, min(period_id) AS period_id,
arg_min(seed_position, period_id) FILTER (seed_position IS NOT NULL) AS seed_position FROM fact GROUP BY entity_id""",
)
def _(spark, d):
    return ag.first_non_null(fact(spark, d), "entity_id", "seed_position", "period_id")


@query(
    "a7_string_agg",
    """SELECT s_nationkey, 0::BIGINT AS part, string_agg(DISTINCT l_shipmode, ', ' ORDER BY l_shipmode) AS flags FROM
(SELECT s_nationkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
GROUP BY s_nationkey""",
)
def _(spark, d):
    suppliers = read_table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    rows = read_table(spark, d, "lineitem").join(suppliers, "l_suppkey")
    return ag.string_agg(rows, "s_nationkey", F.concat("l_returnflag", "l_linestatus"), name="flags")


@query(
    "a8_collect_sorted",
    """WITH n AS (SELECT o_custkey, o_orderkey,
(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS part FROM orders)
SELECT o_custkey, part, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM n GROUP BY ALL""",
)
def _(spark, d):
    parts = ag.collect_sorted(read_table(spark, d, "orders"), "o_custkey", "o_orderkey", part_size=8)
    return parts.select("o_custkey", "part", F.array_join(F.col("o_orderkey_list").cast("array<string>"), ",").alias("keys"))


_QS = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
QUANT_SQL = ", ".join(f"{rnd(f'quantile_cont({{c}}, {q})')} AS {n}" for n, q in _QS.items())


@query(
    "a9_dist_summary",
    f"""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, {rnd("avg(l_extendedprice)")} AS mean_l_extendedprice,
{rnd("stddev_samp(l_extendedprice)")} AS std_l_extendedprice, {QUANT_SQL.format(c="l_extendedprice")} FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    return tidy(
        ag.dist_summary(read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    )


@query("a10_max_or", "SELECT coalesce(max(o_orderkey), 0) AS last_id, (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_orderkey < 0) AS none_id FROM orders")
def _(spark, d):
    orders = read_table(spark, d, "orders")
    none = ag.max_or(orders.filter("o_orderkey < 0"), "o_orderkey", 0, "none_id")
    return ag.max_or(orders, "o_orderkey", 0, "last_id").withColumn("none_id", none.scalar())


@query(
    "a11_dedupe",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (
PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, d):
    rows = od.dedupe(
        read_table(spark, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_extendedprice"
        ),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_extendedprice", "l_quantity"],
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_PRED = """pred AS (SELECT *, avg(points) OVER (PARTITION BY entity_id ORDER BY period_id
ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS predicted FROM fact0)"""


def _pred(spark, d):
    return wn.trailing_mean(base_fact(spark, d), "entity_id", "period_id", "points", 5, "predicted", None)


@query(
    "a12_error_metrics",
    f"""WITH {FACT0}, {_PRED} SELECT season, count(points - predicted) AS n, {rnd("avg(abs(points - predicted))")} AS mae,
{rnd("sqrt(avg((points - predicted) ** 2))")} AS rmse FROM pred GROUP BY season""",
)
def _(spark, d):
    return tidy(ag.error_metrics(_pred(spark, d), "season", "points", "predicted"))


@query(
    "a13_share_of_total",
    f"""WITH g AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderstatus, {rnd("v")} AS o_totalprice, {rnd("100 * v / sum(v) OVER (PARTITION BY o_custkey)")} AS pct FROM g""",
)
def _(spark, d):
    return tidy(ag.share_of_total(read_table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice"))


@query("a14_frequency", "SELECT lang, count(*) AS count FROM documents GROUP BY lang ORDER BY count DESC, lang")
def _(spark, d):
    return ag.frequency(read_table(spark, d, "documents"), "lang")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a15_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {rnd('1.0' if a == b else f'corr({a}, {b})')} AS corr FROM lineitem"
        for a in _NUM
        for b in _NUM
        if a != b
    )
    + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0::DOUBLE" for a in _NUM),
)
def _(spark, d):
    return tidy(ag.correlation_matrix(read_table(spark, d, "lineitem"), _NUM))


# ---------------------------------------------------------------- windows

_EV = "PARTITION BY user_id ORDER BY ts, event_id"
_EV_KEYS = ("user_id", ["ts", "event_id"])


def _events(spark, d):
    return read_table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")


@query(
    "w1_lag_lead",
    f"""SELECT event_id, lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value,
lag(value, 2) OVER w AS prev2_value FROM events WINDOW w AS ({_EV})""",
)
def _(spark, d):
    def cols(w):
        return {
            "prev_value": F.lag("value").over(w),
            "next_value": F.lead("value").over(w),
            "prev2_value": F.lag("value", 2).over(w),
        }

    rows = wn.windowed(_events(spark, d), *_EV_KEYS, cols, before=2, after=1)
    return rows.select("event_id", "prev_value", "next_value", "prev2_value")


@query(
    "w2_trailing_mean",
    f"""SELECT event_id, {rnd(f"avg(value) OVER ({_EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")} AS value_last_5_avg FROM events""",
)
def _(spark, d):
    return tidy(wn.trailing_mean(_events(spark, d), *_EV_KEYS, "value", 5).select("event_id", "value_last_5_avg"))


@query(
    "w3_trailing_mean_lagged",
    f"""WITH p AS (SELECT *, lag(value) OVER ({_EV}) AS prev FROM events)
SELECT event_id, {rnd(f"avg(prev) OVER ({_EV} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")} AS value_last_3_avg FROM p""",
)
def _(spark, d):
    rows = wn.trailing_mean_lagged(_events(spark, d), *_EV_KEYS, "value", 3)
    return tidy(rows.select("event_id", "value_last_3_avg"))


@query(
    "w4_trailing_count_guard",
    f"""WITH p AS (SELECT event_id, count(value) OVER ({_EV} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM events)
SELECT event_id FROM p WHERE n = 3""",
)
def _(spark, d):
    return wn.trailing_count_guard(_events(spark, d), *_EV_KEYS, "value", 3).select("event_id")


@query(
    "w5_trailing_std",
    f"""SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN {rnd("stddev_samp(value) OVER w")} END AS value_last_5_std
FROM events WINDOW w AS ({_EV} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def _(spark, d):
    return tidy(wn.trailing_std(_events(spark, d), *_EV_KEYS, "value", 5).select("event_id", "value_last_5_std"))


@query(
    "w6_season_to_date_mean",
    f"""WITH {FACT0} SELECT entity_id, period_id, {rnd('''avg(points) OVER (PARTITION BY entity_id, season ORDER BY period_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)''')} AS points_season_avg FROM fact0""",
)
def _(spark, d):
    rows = wn.season_to_date_mean(base_fact(spark, d), "entity_id", "season", "period_id", "points", None, None)
    return tidy(rows.select("entity_id", "period_id", "points_season_avg"))


@query(
    "w7_forward_fill",
    f"""WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER ({_EV} ROWS UNBOUNDED PRECEDING), -1) AS v_filled FROM e""",
)
def _(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return wn.forward_fill(rows, *_EV_KEYS, "v", -1.0).select("event_id", "v_filled")


@query(
    "w8_latest_per_key",
    """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (
PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, d):
    return wn.latest_per_key(_events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(
    "w9_number_rows",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_num,
dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) AS month_index FROM orders""",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    rows = number_rows(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "row_num")
    return od.dense_index(rows, [], "month", "month_index").select("o_orderkey", "row_num", "month_index")


@query(
    "w10_dense_rank_desc",
    """SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS date_rank FROM orders""",
)
def _(spark, d):
    rows = read_table(spark, d, "orders")
    return wn.dense_rank_desc(rows, "o_orderpriority", "o_orderdate", "date_rank").select("o_orderkey", "date_rank")


@query(
    "w11_group_stats",
    f"""SELECT event_id, {rnd("avg(value) OVER w")} AS avg_v, {rnd("sum(value) OVER w")} AS sum_v, count(value) OVER w AS n_v
FROM events WINDOW w AS (PARTITION BY event_type)""",
)
def _(spark, d):
    rows = wn.group_stats(
        _events(spark, d), "event_type", {"avg_v": F.avg("value"), "sum_v": F.sum("value"), "n_v": F.count("value")}
    )
    return tidy(rows.select("event_id", "avg_v", "sum_v", "n_v"))


_TEAM = "PARTITION BY period_id, team_id"


@query(
    "w12_rest_of_group_sum",
    f"""WITH {FACT0} SELECT entity_id, period_id, {rnd(f"sum(points) OVER ({_TEAM}) - points")} AS points_rest FROM fact0""",
)
def _(spark, d):
    rows = wn.rest_of_group_sum(base_fact(spark, d), ["period_id", "team_id"], "points")
    return tidy(rows.select("entity_id", "period_id", "points_rest"))


@query(
    "w13_vs_partner",
    f"""WITH {FACT} SELECT entity_id, period_id, CAST(CASE WHEN count(seed_position) OVER w = 2
THEN seed_position - (sum(seed_position) OVER w - seed_position) END AS BIGINT) AS seed_position_vs_partner
FROM fact WINDOW w AS ({_TEAM})""",
)
def _(spark, d):
    rows = wn.vs_partner(fact(spark, d), ["period_id", "team_id"], "seed_position")
    return rows.select("entity_id", "period_id", "seed_position_vs_partner")


@query(
    "w14_group_max",
    f"WITH {FACT0} SELECT entity_id, period_id, max(points) OVER (PARTITION BY pool_id, period_id) AS points_max FROM fact0",
)
def _(spark, d):
    rows = wn.group_max(base_fact(spark, d), ["pool_id", "period_id"], "points")
    return rows.select("entity_id", "period_id", "points_max")


@query(
    "w15_change_and_pct",
    f"""WITH e AS (SELECT event_id, value, lag(value) OVER ({_EV}) AS prev FROM events)
SELECT event_id, {rnd("value - prev")} AS value_change, {rnd("(value - prev) / nullif(prev, 0)")} AS value_change_pct FROM e""",
)
def _(spark, d):
    rows = wn.change_and_pct(_events(spark, d), *_EV_KEYS, "value")
    return tidy(rows.select("event_id", "value_change", "value_change_pct"))


# ---------------------------------------------------------------- sorts


@query("t1_sort", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey")
def _(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return od.sort(rows, ["-o_orderdate", "o_totalprice", "o_orderkey"])


@query("t2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return od.top_k(rows, "-o_totalprice", 10, "o_orderkey")


@query(
    "t2_top_k_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (
PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return od.top_k_per_group(rows, "o_custkey", ["-o_totalprice", "o_orderkey"], 3)


@query(
    "t2_top_k_per_group_hot",
    """SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (
PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 50""",
)
def _(spark, d):
    """Few groups, each a large part of the table and spread over many partitions."""
    rows = read_table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    return od.top_k_per_group(rows.repartition("o_orderkey"), "o_orderstatus", ["-o_totalprice", "o_orderkey"], 50)


@query(
    "t3_last_n_keys",
    "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id ORDER BY last_ts DESC, user_id DESC LIMIT 5",
)
def _(spark, d):
    return od.last_n_keys(read_table(spark, d, "events"), "user_id", "ts", 5)


@query(
    "t4_latest_before",
    f"""WITH {FACT0}, {_SPINE_SQL} SELECT s.entity_id, s.period_id, f.period_id AS seen, f.points
FROM spine s ASOF LEFT JOIN fact0 f ON s.entity_id = f.entity_id AND s.period_id > f.period_id""",
)
def _(spark, d):
    log = base_fact(spark, d).select("entity_id", F.col("period_id").alias("seen"), "points")
    return od.latest_before(_spine(spark, d), log, "entity_id", "period_id", "seen")


@query(
    "t5_next_period",
    f"""WITH {PERIODS} SELECT period_id, date_start FROM dim_period WHERE date_start >= DATE '1997-05-17' ORDER BY date_start LIMIT 1""",
)
def _(spark, d):
    return od.next_period(dim_period(spark, d), "period_id", "date_start", F.to_date(F.lit("1997-05-17")))


@query("t6_sample_violations", "SELECT * FROM supplier WHERE s_acctbal < 0 ORDER BY s_suppkey LIMIT 10")
def _(spark, d):
    return od.sample_violations(read_table(spark, d, "supplier").filter("s_acctbal < 0"), 10, "s_suppkey")


# ---------------------------------------------------------------- sets


@query(
    "u1_union_tagged",
    """SELECT s_suppkey AS id, s_name AS name, 'supplier' AS source FROM supplier
UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer""",
)
def _(spark, d):
    return st.union_tagged(
        {
            "supplier": read_table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name"),
            "customer": read_table(spark, d, "customer").selectExpr("c_custkey id", "c_name name"),
        }
    )


@query(
    "u2_union_loose",
    """SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels""",
)
def _(spark, d):
    return st.union_loose(
        [
            read_table(spark, d, "documents").select("doc_id", "lang"),
            read_table(spark, d, "labels").select("doc_id", "quality"),
        ]
    )


_PERIOD_ONLY, _FACT_ONLY = ["date_start", "is_special", "period_name"], ["entity_id", "points", "pool_id", "price", "team_id"]


@query(
    "u3_column_diff",
    f"WITH {FACT0}, {PERIODS} "
    + " UNION ALL ".join(
        [f"SELECT 'missing' AS kind, '{c}' AS column_name, count({c}) AS n_filled FROM dim_period" for c in _PERIOD_ONLY]
        + [f"SELECT 'extra', '{c}', count({c}) FROM fact0" for c in _FACT_ONLY]
    ),
)
def _(spark, d):
    return st.column_diff_counts(dim_period(spark, d), base_fact(spark, d))


@query(
    "u4_union_priority",
    """SELECT custkey, tag, v FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY src, v) AS rn FROM (
SELECT o_custkey AS custkey, 'urgent' AS tag, o_orderkey AS v, 0 AS src FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT c_custkey, 'customer', c_custkey, 1 FROM customer)) WHERE rn = 1""",
)
def _(spark, d):
    urgent = read_table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    people = read_table(spark, d, "customer")
    return st.union_priority(
        [
            urgent.selectExpr("o_custkey custkey", "'urgent' tag", "o_orderkey v"),
            people.selectExpr("c_custkey custkey", "'customer' tag", "c_custkey v"),
        ],
        "custkey",
        "v",
    )


# ---------------------------------------------------------------- functions


@query(
    "fn01_08_text_functions",
    """SELECT s_suppkey, lower(s_name) AS low, upper(s_name) AS up, trim('  ' || s_name || ' ') AS trimmed,
regexp_replace(lower(trim(' A   ' || s_name || '  b ')), '\\s+', ' ', 'g') AS ws,
TRY_CAST(substr(CAST(1990 + s_suppkey AS VARCHAR) || 'Driver', 1, 4) AS INTEGER) AS year4,
s_nationkey || ' R' || s_suppkey AS label, contains(s_name, '07') AS has07, s_name LIKE 'Supplier#%' AS starts,
coalesce(regexp_matches(s_name, '(?i)supplier#0+1|TEST'), false) AS hit FROM supplier""",
)
def _(spark, d):
    s = F.col("s_name")
    return read_table(spark, d, "supplier").select(
        "s_suppkey",
        F.lower(s).alias("low"),
        F.upper(s).alias("up"),
        F.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("trimmed"),
        fx.normalize_ws(F.concat(F.lit(" A   "), s, F.lit("  b "))).alias("ws"),
        fx.prefix_int(F.concat((F.lit(1990) + F.col("s_suppkey")).cast("string"), F.lit("Driver")), 4).alias("year4"),
        fx.label(F.col("s_nationkey"), " R", F.col("s_suppkey")).alias("label"),
        fx.contains(s, "07").alias("has07"),
        fx.starts_with(s, "Supplier#").alias("starts"),
        fx.matches(s, "supplier#0+1|TEST").alias("hit"),
    )


@query(
    "fn09_13_time_functions",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
CAST(epoch(o_orderdate) AS BIGINT) AS secs, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS tid,
o_orderdate AS iso, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS bad,
o_orderdate + INTERVAL 23 HOUR + INTERVAL 30 MINUTE AS logged FROM orders""",
)
def _(spark, d):
    t = F.col("o_orderdate")
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    log = F.concat(F.date_format(t, "M/d/yyyy"), F.lit(" 23:30"))
    rows = read_table(spark, d, "orders").select(
        "o_orderkey",
        F.year(t).alias("y"),
        F.month(t).alias("m"),
        fx.epoch_seconds(t).alias("secs"),
        fx.time_id(F.year(t), F.month(t)).alias("tid"),
        fx.parse_ts_utc(text).alias("iso"),
        fx.parse_ts_utc(F.when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(text)).alias("bad"),
        fx.parse_ts_fmt(log).alias("logged"),
    )
    return tidy(rows)


@query(
    "fn15_27_number_functions",
    f"""SELECT s_suppkey, abs(s_acctbal) AS absolute, round(s_acctbal, 1) + 0.0 AS up1,
round_even(s_acctbal, 1) + 0.0 AS even1, {rnd("s_acctbal / nullif(s_nationkey, 0)")} AS ratio,
{rnd("1 / (1 + pow(10, (1500 - s_acctbal) / 400))")} AS expected, {rnd("sqrt(abs(s_acctbal))")} AS root,
s_acctbal = 'inf'::DOUBLE AS infinite, greatest(s_acctbal, 0) AS clipped, least(s_acctbal, 100) AS low,
CASE WHEN s_acctbal > 0 THEN 'pos' ELSE 'neg' END AS sign, coalesce(nullif(s_nationkey, 0), -1) AS team,
nullif(s_nationkey, 0) IS NULL AS missing, CAST(s_acctbal > 0 AS INTEGER) AS flag,
TRY_CAST(CASE WHEN s_nationkey = 3 THEN 'n/a' ELSE CAST(s_suppkey AS VARCHAR) END AS DOUBLE) AS num FROM supplier""",
)
def _(spark, d):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    rows = read_table(spark, d, "supplier").select(
        "s_suppkey",
        F.abs(b).alias("absolute"),
        fx.round_half_up(b, 1).alias("up1"),
        fx.round_half_even(b, 1).alias("even1"),
        F.round(fx.safe_divide(b, n) + 1e-9, 6).alias("ratio"),
        F.round(fx.expected_score(b, F.lit(1500.0)) + 1e-9, 6).alias("expected"),
        F.round(F.sqrt(F.abs(b)) + 1e-9, 6).alias("root"),
        fx.is_infinite(b).alias("infinite"),
        fx.clip_low(b).alias("clipped"),
        F.least(b, F.lit(100.0)).alias("low"),
        F.when(b > 0, "pos").otherwise("neg").alias("sign"),
        F.coalesce(F.nullif(n, F.lit(0)), F.lit(-1)).alias("team"),
        F.nullif(n, F.lit(0)).isNull().alias("missing"),
        (b > 0).cast("int").alias("flag"),
        fx.to_number(F.when(n == 3, F.lit("n/a")).otherwise(F.col("s_suppkey").cast("string"))).alias("num"),
    )
    return rows


@query(
    "fn28_31_nested_functions",
    """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[1000] AS DOUBLE) AS past,
coalesce(map {'0': 'zero', '1': 'one'}[CAST(label AS VARCHAR)], CAST(label AS VARCHAR)) AS name FROM embeddings""",
)
def _(spark, d):
    text = F.col("label").cast("string")
    return read_table(spark, d, "embeddings").select(
        "vec_id",
        fx.element(F.col("embedding"), 0).cast("double").alias("first"),
        fx.element(F.col("embedding"), 999).cast("double").alias("past"),
        fx.map_values(text, {"0": "zero", "1": "one"}).alias("name"),
    )


@query("fn29_rows_of", "SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS id FROM orders")
def _(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", fx.rows_of(F.col("o_orderkey"), F.col("o_custkey")).alias("id"))


@query(
    "fn30_json_field",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def _(spark, d):
    return read_table(spark, d, "events").select("event_id", fx.json_field(F.col("props"), "k int", "k").alias("k"))


# ---------------------------------------------------------------- plans for hot keys


@query("w2_trailing_mean_split", ORACLE["w2_trailing_mean"])
def _(spark, d):
    """The plan for keys too large for one task."""
    rows = wn.trailing_mean(_events(spark, d), *_EV_KEYS, "value", 5, max_group_rows=20)
    return tidy(rows.select("event_id", "value_last_5_avg"))


@query("w6_season_to_date_mean_split", ORACLE["w6_season_to_date_mean"])
def _(spark, d):
    """The plan for keys too large for one task."""
    rows = wn.season_to_date_mean(base_fact(spark, d), "entity_id", "season", "period_id", "points", None, 0)
    return tidy(rows.select("entity_id", "period_id", "points_season_avg"))


@query("w7_forward_fill_split", ORACLE["w7_forward_fill"])
def _(spark, d):
    """The plan for keys too large for one task."""
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return wn.forward_fill(rows, *_EV_KEYS, "v", -1.0, max_group_rows=0).select("event_id", "v_filled")


@query("a9_dist_summary_split", ORACLE["a9_dist_summary"])
def _(spark, d):
    """The plan for keys too large for one task."""
    keys = ["l_returnflag", "l_linestatus"]
    return tidy(ag.dist_summary(read_table(spark, d, "lineitem"), keys, "l_extendedprice", max_group_rows=0))


@query("j9_asof_carry_split", ORACLE["j9_asof_carry"])
def _(spark, d):
    """The plan for keys too large for one task."""
    obs = base_fact(spark, d).select("entity_id", F.col("period_id").alias("seen"), "points")
    return jn.asof_carry(_spine(spark, d), obs, "entity_id", "period_id", "seen", "points", {"points": 1500.0}, max_group_rows=0)
