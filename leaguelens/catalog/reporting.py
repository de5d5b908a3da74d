"""Queries for selections, marts, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaguelens.catalog.analytics import (
    PRED,
    _stats_sql,
    entity_feature_table,
    predictions,
    rating_sql,
)
from leaguelens.catalog.fixture import (
    DIMS,
    FACT,
    FACT0,
    base_fact,
    day,
    dim_entity,
    dim_period,
    dim_team,
    fact,
)
from leaguelens.catalog.registry import query, rnd, tidy
from leaguelens.operators.aggregates import dist_summary, error_metrics
from leaguelens.operators.common import number_rows
from leaguelens.plans import marts as mt
from leaguelens.plans import models as ml
from leaguelens.plans import rating as rt
from leaguelens.plans import selection as se
from leaguelens.session import checkpointed, shared_folder
from leaguelens.sources.tables import read_table
from leaguelens.streaming.append_stream import stream_append_new
from leaguelens.streaming.rating_stream import open_ratings, stream_rating

# ---------------------------------------------------------------- selections

_GRID = ["pool_id", "period_id"]
_CUT = 70.0


def _assets(spark, d):
    rows = checkpointed(fact(spark, d))
    ents = rows.select(*_GRID, "entity_id", "team_id", "price", "points")
    teams = rows.groupBy(*_GRID, "team_id").agg(
        F.round(F.avg("price") + 1e-9, 4).alias("price"), F.round(F.sum("points") + 1e-9, 4).alias("points")
    )
    budgets = rows.select(*_GRID).distinct().withColumn("budget", F.lit(_CUT))
    prior = rows.filter("position = 1").select(
        *_GRID, F.lit("entity").alias("asset_type"), F.col("entity_id").alias("asset_id")
    )
    return ents, teams, budgets, prior


_ASSETS = f"""{FACT}, ents AS (SELECT pool_id, period_id, entity_id, team_id, price, points,
  CASE WHEN position = 1 THEN 0 ELSE 1 END AS is_new FROM fact),
teams AS (SELECT pool_id, period_id, team_id, round(avg(price) + 1e-9, 4) AS price, round(sum(points) + 1e-9, 4) AS points FROM fact GROUP BY ALL)"""

_BEST = f"""combos AS (SELECT a.pool_id, a.period_id, a.entity_id AS e1, b.entity_id AS e2, c.entity_id AS e3, t.team_id AS t1,
  a.price + b.price + c.price + t.price AS total_price, a.points + b.points + c.points + t.points + greatest(a.points, b.points, c.points) AS gross_points,
  a.is_new + b.is_new + c.is_new + 1 AS moves
  FROM ents a JOIN ents b ON a.pool_id = b.pool_id AND a.period_id = b.period_id AND a.entity_id < b.entity_id
  JOIN ents c ON a.pool_id = c.pool_id AND a.period_id = c.period_id AND b.entity_id < c.entity_id
  JOIN teams t ON a.pool_id = t.pool_id AND a.period_id = t.period_id
  WHERE a.price + b.price + c.price + t.price <= {_CUT} + 1e-9),
best AS (SELECT *, gross_points - 10 * greatest(0, moves - 2) AS net_points FROM combos
  QUALIFY row_number() OVER (PARTITION BY pool_id, period_id ORDER BY round(gross_points - 10 * greatest(0, moves - 2), 6) DESC, total_price) = 1)"""

_RULES = se.SelectionRules(n_entities=3, n_teams=1, bonus_multiplier=2.0)


def _best(spark, d):
    ents, teams, budgets, prior = _assets(spark, d)
    return se.best_selection(ents, teams, budgets, _GRID, prior, _RULES), ents, teams, prior


@query(
    "g16_best_selection",
    f"""WITH {_ASSETS}, {_BEST} SELECT pool_id, period_id, e1 || ',' || e2 || ',' || e3 AS entity_ids, CAST(t1 AS VARCHAR) AS team_ids,
{rnd("total_price")} AS total_price, {rnd("gross_points")} AS gross_points, CAST(moves AS BIGINT) AS total_transfers,
{rnd("net_points")} AS net_points FROM best""",
)
def _(spark, d):
    best = _best(spark, d)[0]
    ids = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("entity_ids", "team_ids")}
    cols = [*_GRID, "entity_ids", "team_ids", "total_price", "gross_points", "total_transfers", "net_points"]
    return tidy(best.withColumns(ids).select(*cols))


@query(
    "g17_selection_rows",
    f"""WITH {_ASSETS}, {_BEST}, picked AS (SELECT pool_id, period_id, unnest([e1, e2, e3]) AS entity_id FROM best),
r AS (SELECT e.pool_id, e.period_id, 'entity' AS asset_type, e.entity_id AS asset_id, e.team_id, e.price, e.points, e.is_new = 1 AS is_transfer_in
FROM ents e JOIN picked p USING (pool_id, period_id, entity_id)
UNION ALL SELECT t.pool_id, t.period_id, 'team', t.team_id, t.team_id, t.price, t.points, true FROM teams t
JOIN best b ON b.pool_id = t.pool_id AND b.period_id = t.period_id AND b.t1 = t.team_id),
n AS (SELECT *, row_number() OVER (PARTITION BY pool_id, period_id, asset_type ORDER BY points DESC, asset_id) AS slot_num FROM r)
SELECT *, asset_type = 'entity' AND slot_num = 1 AS is_bonus FROM n""",
)
def _(spark, d):
    best, ents, teams, prior = _best(spark, d)
    return se.selection_rows(checkpointed(best), ents, teams, _GRID, prior)


@query("g16_best_selection_team_rules")
def _(spark, d):
    """The full rule set (five entities, two teams, one entity at least per chosen team)."""
    ents, teams, _, _ = _assets(spark, d)
    budgets = teams.select(*_GRID).distinct().withColumn("budget", F.lit(140.0))
    rules = se.SelectionRules(max_entities_per_team=3, min_entities_per_chosen_team=1)
    return tidy(se.best_selection(ents, teams, budgets, _GRID, None, rules))


def _config(spark, d):
    rows = fact(spark, d).filter("position <= 3")
    top = rows.groupBy(F.concat(F.lit("pool "), F.col("pool_id").cast("string")).alias("selection_name"), "period_id")
    # a grid with fewer entities leaves slots empty
    picks = [F.max(F.when(F.col("position") == i, F.col("entity_id"))).alias(f"entity_{i}_id") for i in (1, 2, 3)]
    return top.agg(*picks, F.max(F.when(F.col("position") == 1, F.col("team_id"))).alias("team_1_id"))


@query(
    "g18_prior_selection",
    f"""WITH {FACT}, l AS (SELECT max(period_id) AS period_id FROM fact WHERE pool_id = 2 AND period_id < 199901)
SELECT 'pool 2' AS selection_name, f.period_id, 'entity' AS asset_type, entity_id AS asset_id FROM fact f JOIN l USING (period_id)
WHERE pool_id = 2 AND position <= 3 UNION ALL
SELECT 'pool 2', f.period_id, 'team', team_id FROM fact f JOIN l USING (period_id) WHERE pool_id = 2 AND position = 1""",
)
def _(spark, d):
    return se.prior_selection(_config(spark, d), 199901, "pool 2", n_entities=3, n_teams=1)


# Logs derived from the fact: one selection run, of the whole field, and one simulation run per grid.
RUNS = f"""sel AS (SELECT pool_id * 1000000 + period_id AS selection_run_id, * FROM fact),
sel_run AS (SELECT selection_run_id, any_value(season) AS season, any_value(period_id) AS period_id,
  make_timestamp(any_value(season), any_value(period_num), 2, 0, 0, 0) AS created_at, 'pool ' || any_value(pool_id) AS selection_name,
  {rnd("sum(price)")} AS total_price, {rnd("sum(points)")} AS gross_points, min(CASE WHEN position = 1 THEN entity_id END) AS bonus_entity_id,
  bool_or(seed_position IS NULL) AS require_entity_from_each_team FROM sel GROUP BY selection_run_id),
sel_rows AS (SELECT selection_run_id, 'entity' AS asset_type, position AS slot_num, entity_id AS asset_id, team_id, price, points, position = 1 AS is_bonus FROM sel),
sim_run AS (SELECT selection_run_id + 7 AS simulation_run_id, created_at, period_id, 42 AS random_seed, 100 AS n_sims FROM sel_run),
prof AS (SELECT selection_run_id + 7 AS simulation_run_id, 'whole field' AS profile_name, CASE WHEN max(pool_id) < 3 THEN 'max_points' ELSE 'team_required' END AS profile_strategy,
  CASE WHEN max(pool_id) < 4 THEN selection_run_id END AS selection_run_id, {_stats_sql("points").replace("mean_points", "mean_selection_points").replace("std_points", "std_selection_points")}
  FROM sel GROUP BY selection_run_id)"""


def _logs(spark, d):
    rows = checkpointed(fact(spark, d))
    run = (F.col("pool_id") * 1000000 + F.col("period_id")).alias("selection_run_id")
    sel = rows.select(run, "*")
    sel_run = sel.groupBy("selection_run_id").agg(
        F.min("season").alias("season"),
        F.min("period_id").alias("period_id"),
        day(F.min("season"), F.min("period_num"), 2).alias("created_at"),
        F.concat(F.lit("pool "), F.min("pool_id").cast("string")).alias("selection_name"),
        F.sum("price").alias("total_price"),
        F.sum("points").alias("gross_points"),
        F.min(F.when(F.col("position") == 1, F.col("entity_id"))).alias("bonus_entity_id"),
        F.bool_or(F.col("seed_position").isNull()).alias("require_entity_from_each_team"),
    )
    sel_rows = sel.select(
        "selection_run_id",
        F.lit("entity").alias("asset_type"),
        F.col("position").alias("slot_num"),
        F.col("entity_id").alias("asset_id"),
        "team_id",
        "price",
        "points",
        (F.col("position") == 1).alias("is_bonus"),
    )
    sim_run = sel_run.select(
        (F.col("selection_run_id") + 7).alias("simulation_run_id"),
        "created_at",
        "period_id",
        F.lit(42).alias("random_seed"),
        F.lit(100).alias("n_sims"),
    )
    # a run has the entities of one grid
    stats = dist_summary(sel, ["selection_run_id", "pool_id"], "points", max_group_rows=None)
    prof = stats.withColumnsRenamed({"mean_points": "mean_selection_points", "std_points": "std_selection_points"})
    prof = prof.withColumns(
        {
            "simulation_run_id": F.col("selection_run_id") + 7,
            "profile_name": F.lit("whole field"),
            "profile_strategy": F.when(F.col("pool_id") < 3, "max_points").otherwise("team_required"),
            "selection_run_id": F.when(F.col("pool_id") < 4, F.col("selection_run_id")),
        }
    ).drop("pool_id")
    return sel_run, sel_rows, sim_run, prof


@query(
    "g19_find_existing_run",
    f"""WITH {FACT}, {RUNS} SELECT min(selection_run_id) AS selection_run_id FROM sel_run
WHERE selection_name = 'pool 3' AND require_entity_from_each_team = true""",
)
def _(spark, d):
    settings = {"selection_name": "pool 3", "require_entity_from_each_team": True}
    return se.find_existing_run(_logs(spark, d)[0], settings)


@query(
    "g22_spend_analysis",
    f"""WITH {_ASSETS}, picked AS (SELECT pool_id, period_id, 'entity' AS asset_type, price FROM fact
UNION ALL SELECT pool_id, period_id, 'team', price FROM teams)
SELECT pool_id, period_id, {rnd("sum(price) FILTER (asset_type = 'entity')")} AS entity_spend, {rnd("sum(price) FILTER (asset_type = 'team')")} AS team_spend,
{rnd("100 * sum(price) FILTER (asset_type = 'entity') / sum(price)")} AS entity_pct, {rnd("100 * sum(price) FILTER (asset_type = 'team') / sum(price)")} AS team_pct,
count(*) FILTER (asset_type = 'entity' AND price < 10) AS n_cheap, count(*) FILTER (asset_type = 'entity' AND price >= 10 AND price < 20) AS n_mid,
count(*) FILTER (asset_type = 'entity' AND price >= 20) AS n_premium FROM picked GROUP BY ALL""",
)
def _(spark, d):
    rows = checkpointed(fact(spark, d))
    teams = rows.groupBy(*_GRID, "team_id").agg(F.round(F.avg("price") + 1e-9, 4).alias("price"))
    picked = rows.select(*_GRID, F.lit("entity").alias("asset_type"), "price")
    picked = picked.unionByName(teams.select(*_GRID, F.lit("team").alias("asset_type"), "price"))
    return tidy(se.spend_analysis(picked, _GRID))


@query(
    "g27_compare_selections",
    f"""WITH {FACT}, {RUNS} SELECT profile_strategy, s.asset_type, s.slot_num, s.asset_id, s.price, s.points FROM prof p
LEFT JOIN sel_rows s USING (selection_run_id) WHERE simulation_run_id = 2 * 1000000 + 199905 + 7 AND profile_strategy IN ('max_points', 'team_required')""",
)
def _(spark, d):
    _, sel_rows, _, prof = _logs(spark, d)
    out = se.compare_selections(prof, sel_rows, 2 * 1000000 + 199905 + 7, ["max_points", "team_required"])
    return out.select("profile_strategy", "asset_type", "slot_num", "asset_id", "price", "points")


# ---------------------------------------------------------------- marts

LOGS = f"""log AS (SELECT CAST(season - 1990 AS BIGINT) AS prediction_run_id, season, period_id, entity_id, team_id, price,
  {rnd("predicted_points")} AS predicted_points, 'm' || (season % 3) AS model_name, season % 2 = 0 AS is_production_run,
  make_timestamp(season, 1, 1, 0, 0, 0) AS prediction_timestamp FROM pred),
team_log AS (SELECT CAST(season - 1990 AS BIGINT) AS prediction_run_id, season, period_id, team_id, {rnd("sum(predicted_points)")} AS predicted_points,
  season = 1997 AS is_production_run FROM pred GROUP BY ALL)"""


def _prediction_logs(spark, d):
    run = (F.col("season") - 1990).cast("long").alias("prediction_run_id")
    log = checkpointed(
        predictions(spark, d).select(
            run,
            "season",
            "period_id",
            "entity_id",
            "team_id",
            "price",
            F.round(F.col("predicted_points") + 1e-9, 6).alias("predicted_points"),
            F.concat(F.lit("m"), (F.col("season") % 3).cast("string")).alias("model_name"),
            (F.col("season") % 2 == 0).alias("is_production_run"),
            day(F.col("season"), F.lit(1), 1).alias("prediction_timestamp"),
        )
    )
    team = predictions(spark, d).groupBy(run, "season", "period_id", "team_id")
    team = team.agg(F.sum("predicted_points").alias("predicted_points"))
    return log, team.withColumn("is_production_run", F.col("season") == 1997)


_NAMES = "p.period_num, p.period_name, p.is_special"
_JOIN3 = "LEFT JOIN dim_entity e USING (entity_id) LEFT JOIN dim_team t USING (team_id) LEFT JOIN dim_period p USING (period_id)"


def _dims(spark, d):
    return dim_entity(spark, d), dim_team(spark, d), dim_period(spark, d)


@query(
    "r1_mart_entity_predictions",
    f"WITH {FACT0}, {DIMS}, {PRED}, {LOGS} SELECT l.*, e.entity_name, e.acronym, t.team_name, {_NAMES} FROM log l {_JOIN3}",
)
def _(spark, d):
    return mt.mart_entity_predictions(_prediction_logs(spark, d)[0], *_dims(spark, d))


@query(
    "r2_mart_team_predictions",
    f"""WITH {FACT0}, {DIMS}, {PRED}, {LOGS} SELECT l.*, t.team_name, {_NAMES} FROM team_log l
LEFT JOIN dim_team t USING (team_id) LEFT JOIN dim_period p USING (period_id)""",
)
def _(spark, d):
    _, team, period = _dims(spark, d)
    return tidy(mt.mart_team_predictions(_prediction_logs(spark, d)[1], team, period))


_BAND = """CASE WHEN l.predicted_points < 0 THEN '< 0' WHEN l.predicted_points < 5 THEN '0-5' WHEN l.predicted_points < 10 THEN '5-10'
WHEN l.predicted_points < 15 THEN '10-15' WHEN l.predicted_points < 20 THEN '15-20' ELSE '20+' END"""


@query(
    "r3_mart_residuals",
    f"""WITH {FACT0}, {DIMS}, {PRED}, {LOGS} SELECT l.*, f.points AS actual_points, {rnd("f.points - l.predicted_points")} AS residual,
{rnd("abs(f.points - l.predicted_points)")} AS abs_residual, {_BAND} AS prediction_bucket, e.entity_name, e.acronym, t.team_name, {_NAMES}
FROM log l JOIN (SELECT entity_id, period_id, points FROM fact0) f USING (entity_id, period_id) {_JOIN3} WHERE l.predicted_points IS NOT NULL""",
)
def _(spark, d):
    return tidy(mt.mart_residuals(_prediction_logs(spark, d)[0], base_fact(spark, d), *_dims(spark, d)))


EVAL = f"""er AS (SELECT prediction_run_id, avg(abs(f.points - l.predicted_points)) AS mae, sqrt(avg((f.points - l.predicted_points) ** 2)) AS rmse
  FROM log l JOIN fact0 f USING (entity_id, period_id) GROUP BY 1),
results AS (SELECT prediction_run_id, model_type, mae * w AS cv_mae, mae * 0.9 AS train_mae, rmse * 0.9 AS train_rmse, mae * w AS test_mae, rmse * w AS test_rmse
  FROM er, (VALUES ('Random Forest', 1.0::DOUBLE), ('Linear', 1.25::DOUBLE)) v(model_type, w)),
runs AS (SELECT DISTINCT prediction_run_id, prediction_timestamp AS created_at, model_name, 'entity' AS asset_type FROM log),
naive AS (SELECT CAST(season - 1990 AS BIGINT) AS prediction_run_id, CASE WHEN season <> 1996 THEN stddev_samp(points) END AS test_mae,
  stddev_samp(points) * 1.5 AS test_rmse FROM fact0 GROUP BY season)"""


def _evaluation(spark, d):
    log, team_log = _prediction_logs(spark, d)
    actual = base_fact(spark, d).select("entity_id", "period_id", "points")
    er = error_metrics(log.join(actual, ["entity_id", "period_id"]), "prediction_run_id", "points", "predicted_points")
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("model_type"), F.lit(w).alias("w")) for k, w in (("Random Forest", 1.0), ("Linear", 1.25))]))
    mae, rmse, w = F.col("mae"), F.col("rmse"), F.col("w")
    results = er.select("*", kinds).select(
        "prediction_run_id",
        "model_type",
        (mae * w).alias("cv_mae"),
        (mae * 0.9).alias("train_mae"),
        (rmse * 0.9).alias("train_rmse"),
        (mae * w).alias("test_mae"),
        (rmse * w).alias("test_rmse"),
    )
    runs = log.select(
        "prediction_run_id", F.col("prediction_timestamp").alias("created_at"), "model_name", F.lit("entity").alias("asset_type")
    ).distinct()
    naive = base_fact(spark, d).groupBy("season").agg(F.stddev_samp("points").alias("s"))
    naive = naive.select(
        (F.col("season") - 1990).cast("long").alias("prediction_run_id"),
        F.when(F.col("season") != 1996, F.col("s")).alias("test_mae"),
        (F.col("s") * 1.5).alias("test_rmse"),
    )
    return results, runs, log, team_log, naive


@query(
    "r4_mart_model_evaluation",
    f"""WITH {FACT0}, {PRED}, {LOGS}, {EVAL}, flags AS (SELECT prediction_run_id, bool_or(is_production_run) AS is_production_run FROM (
SELECT prediction_run_id, is_production_run FROM log UNION ALL SELECT prediction_run_id, is_production_run FROM team_log) GROUP BY 1)
SELECT r.prediction_run_id, CASE WHEN model_type IN ('Random Forest', 'RandomForest') THEN 'RandomForest' ELSE model_type END AS model_type,
{rnd("cv_mae")} AS cv_mae, {rnd("train_mae")} AS train_mae, {rnd("train_rmse")} AS train_rmse, {rnd("r.test_mae")} AS test_mae, {rnd("r.test_rmse")} AS test_rmse,
created_at, model_name, asset_type, is_production_run, {rnd("n.test_mae")} AS naive_test_mae, {rnd("n.test_rmse")} AS naive_test_rmse,
{rnd("n.test_mae - r.test_mae")} AS mae_vs_naive, {rnd("n.test_rmse - r.test_rmse")} AS rmse_vs_naive,
{rnd("(n.test_mae - r.test_mae) / nullif(n.test_mae, 0)")} AS mae_pct_improvement_vs_naive,
{rnd("(n.test_rmse - r.test_rmse) / nullif(n.test_rmse, 0)")} AS rmse_pct_improvement_vs_naive
FROM results r LEFT JOIN runs USING (prediction_run_id) LEFT JOIN flags USING (prediction_run_id) LEFT JOIN naive n USING (prediction_run_id)""",
)
def _(spark, d):
    return tidy(mt.mart_model_evaluation(*_evaluation(spark, d)))


@query(
    "r5_mart_selection_runs",
    f"""WITH {FACT}, {DIMS}, {RUNS} SELECT r.*, p.period_num, p.period_name, p.date_start, p.is_special, e.entity_name AS bonus_entity_name
FROM sel_run r LEFT JOIN dim_period p USING (period_id) LEFT JOIN dim_entity e ON e.entity_id = r.bonus_entity_id""",
)
def _(spark, d):
    return tidy(mt.mart_selection_runs(_logs(spark, d)[0], dim_period(spark, d), dim_entity(spark, d)))


@query(
    "r6_mart_sim_profiles",
    f"""WITH {FACT}, {DIMS}, {RUNS} SELECT x.*, s.created_at, s.period_id, s.random_seed, s.n_sims, {_NAMES},
{rnd("p90 - p10")} AS selection_risk_range, {rnd("mean_selection_points - p10")} AS selection_downside_gap
FROM prof x LEFT JOIN sim_run s USING (simulation_run_id) LEFT JOIN dim_period p USING (period_id)""",
)
def _(spark, d):
    _, _, sim_run, prof = _logs(spark, d)
    return tidy(mt.mart_sim_profiles(prof, sim_run, dim_period(spark, d)))


@query(
    "r7_mart_sim_entities",
    f"""WITH {FACT}, {DIMS}, {RUNS}, sm AS (SELECT pool_id * 1000000 + period_id + 7 AS simulation_run_id, period_id, entity_id, team_id, price,
points AS mean_simulated_points FROM fact) SELECT x.*, s.created_at, s.random_seed, s.n_sims, e.entity_name, e.acronym, t.team_name, {_NAMES}
FROM sm x LEFT JOIN (SELECT simulation_run_id, created_at, random_seed, n_sims FROM sim_run) s USING (simulation_run_id) {_JOIN3}""",
)
def _(spark, d):
    _, _, sim_run, _ = _logs(spark, d)
    summary = base_fact(spark, d).select(
        (F.col("pool_id") * 1000000 + F.col("period_id") + 7).alias("simulation_run_id"),
        "period_id",
        "entity_id",
        "team_id",
        "price",
        F.col("points").alias("mean_simulated_points"),
    )
    return mt.mart_sim_entities(summary, sim_run, *_dims(spark, d))


@query(
    "r8_mart_sim_runs",
    f"""WITH {FACT}, {DIMS}, {RUNS} SELECT s.*, p.season, {_NAMES} FROM sim_run s LEFT JOIN dim_period p USING (period_id)""",
)
def _(spark, d):
    return mt.mart_sim_runs(_logs(spark, d)[2], dim_period(spark, d))


@query(
    "r9_mart_sim_selection",
    f"""WITH {FACT}, {DIMS}, {RUNS} SELECT simulation_run_id, profile_name, s.created_at, s.period_id, selection_run_id, r.asset_type, r.slot_num,
r.asset_id, e.entity_name, t.team_name, p.period_name, r.price, r.points, r.is_bonus FROM prof x LEFT JOIN sim_run s USING (simulation_run_id)
LEFT JOIN sel_rows r USING (selection_run_id) LEFT JOIN dim_entity e ON e.entity_id = r.asset_id LEFT JOIN dim_team t USING (team_id)
LEFT JOIN dim_period p USING (period_id) WHERE selection_run_id IS NOT NULL""",
)
def _(spark, d):
    _, sel_rows, sim_run, prof = _logs(spark, d)
    out = mt.mart_sim_selection(prof, sim_run, sel_rows, *_dims(spark, d))
    cols = [
        "simulation_run_id", "profile_name", "created_at", "period_id", "selection_run_id", "asset_type", "slot_num",
        "asset_id", "entity_name", "team_name", "period_name", "price", "points", "is_bonus",
    ]
    return out.select(*cols)


_JUDGED = f"""{FACT0}, {PRED}, j AS (SELECT *, {rnd("predicted_points")} AS pp, points - {rnd("predicted_points")} AS x FROM pred WHERE predicted_points IS NOT NULL)"""


def _judged(spark, d):
    rows = predictions(spark, d).withColumnRenamed("points", "actual_points")
    return rows.withColumn("predicted_points", F.round(F.col("predicted_points") + 1e-9, 6))


@query("r10_feed_pred_vs_actual", f"WITH {_JUDGED} SELECT pp AS predicted_points, points AS actual_points FROM j")
def _(spark, d):
    return mt.feed_pred_vs_actual(_judged(spark, d))


@query(
    "r10_feed_mae_by_period",
    f"WITH {_JUDGED} SELECT season, period_num, {rnd('avg(abs(x))')} AS mae, season || ' R' || period_num AS period_label FROM j GROUP BY season, period_num",
)
def _(spark, d):
    return tidy(mt.feed_mae_by_period(_judged(spark, d)))


@query(
    "r10_feed_residual_histogram",
    f"""WITH {_JUDGED}, e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 25 AS w FROM j),
c AS (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 24) AS bin, count(*) AS n FROM j, e GROUP BY 1)
SELECT b.bin, {rnd("lo + b.bin * w")} AS bin_start, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, 25)) AS bin) b CROSS JOIN e LEFT JOIN c USING (bin)""",
)
def _(spark, d):
    return tidy(mt.feed_residual_histogram(_judged(spark, d)))


@query(
    "r10_feed_top_misses",
    f"""WITH {_JUDGED} SELECT entity_id, period_id, {rnd("x")} AS residual, {rnd("abs(x)")} AS abs_error FROM j
ORDER BY abs(x) DESC, period_id, entity_id LIMIT 10""",
)
def _(spark, d):
    return tidy(mt.feed_errors(_judged(spark, d), 10).select("entity_id", "period_id", "residual", "abs_error"))


@query(
    "r10_feed_best_hits",
    f"""WITH {_JUDGED} SELECT entity_id, period_id, {rnd("abs(x)")} AS abs_error FROM j ORDER BY round(abs(x), 9), period_id, entity_id LIMIT 10""",
)
def _(spark, d):
    rows = _judged(spark, d)
    return tidy(mt.feed_errors(rows, 10, worst=False).select("entity_id", "period_id", "abs_error"))


@query(
    "r10_feed_rating_trend",
    f"WITH {FACT} SELECT entity_id, period_id, dense_rank() OVER (ORDER BY period_id) AS period_index, rating_after FROM fact",
)
def _(spark, d):
    return mt.feed_rating_trend(fact(spark, d))


# ---------------------------------------------------------------- models


@query(
    "m1_split_last_periods",
    f"""WITH {FACT0}, last AS (SELECT DISTINCT period_id FROM fact0 ORDER BY period_id DESC LIMIT 4)
SELECT entity_id, period_id, period_id IN (SELECT period_id FROM last) AS is_test FROM fact0""",
)
def _(spark, d):
    train, test = ml.split_last_periods(base_fact(spark, d).select("entity_id", "period_id"))
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query(
    "m2_split_hash",
    f"""WITH {FACT0} SELECT entity_id, period_id,
('0x' || substr(md5(entity_id || '|' || period_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS is_test FROM fact0""",
)
def _(spark, d):
    train, test = ml.split_hash(base_fact(spark, d).select("entity_id", "period_id"), ["entity_id", "period_id"])
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query(
    "m3_naive_baseline",
    f"""WITH {FACT0}, last AS (SELECT DISTINCT period_id FROM fact0 ORDER BY period_id DESC LIMIT 4),
m AS (SELECT avg(points) AS b FROM fact0 WHERE period_id NOT IN (SELECT period_id FROM last))
SELECT {rnd("avg(abs(points - b))")} AS test_mae, {rnd("sqrt(avg((points - b) ** 2))")} AS test_rmse, {rnd("any_value(b)")} AS baseline
FROM fact0, m WHERE period_id IN (SELECT period_id FROM last)""",
)
def _(spark, d):
    train, test = ml.split_last_periods(base_fact(spark, d))
    return tidy(ml.naive_baseline(train, test))


@query(
    "m6_expanding_folds",
    f"""WITH {FACT0}, n AS (SELECT *, row_number() OVER (ORDER BY season, period_id, entity_id) AS rn, count(*) OVER () AS n FROM fact0)
SELECT entity_id, period_id, CAST(CASE WHEN rn <= n - (n // 6) * 5 THEN 0 ELSE 1 + (rn - (n - (n // 6) * 5) - 1) // (n // 6) END AS INTEGER) AS fold FROM n""",
)
def _(spark, d):
    rows = ml.expanding_folds(base_fact(spark, d), ["season", "period_id", "entity_id"], 5)
    return rows.select("entity_id", "period_id", "fold")


@query(
    "m12_log_predictions",
    f"""WITH {FACT0}, {PRED}, {LOGS} SELECT (SELECT max(prediction_run_id) + 1 FROM log) AS prediction_run_id, TIMESTAMP '2026-01-02 03:04:05' AS prediction_timestamp,
entity_id, period_id, {rnd("predicted_points")} AS predicted_points, 'GradientBoosting' AS model_name, 'v2' AS model_version FROM pred""",
)
def _(spark, d):
    log, _ = _prediction_logs(spark, d)
    rows = predictions(spark, d).select("entity_id", "period_id", "predicted_points")
    meta = {"model_name": "GradientBoosting", "model_version": "v2"}
    _, out = ml.log_predictions(rows, log, meta, "2026-01-02 03:04:05")
    return tidy(out)


@query(
    "m13_log_performance",
    f"""WITH {FACT0}, {PRED}, {LOGS}, {EVAL} SELECT r.prediction_run_id, model_type, {rnd("(n.test_mae - cv_mae) / nullif(n.test_mae, 0)")} AS expected_improvement,
{rnd("(n.test_mae - r.test_mae) / nullif(n.test_mae, 0)")} AS realized_improvement, {rnd("r.test_mae - train_mae")} AS overfit_underfit,
{rnd("r.test_rmse - train_rmse")} AS rmse_overfit_underfit_gap, {rnd("r.test_mae - cv_mae")} AS generalization
FROM results r LEFT JOIN naive n USING (prediction_run_id)""",
)
def _(spark, d):
    results, _, _, _, naive = _evaluation(spark, d)
    cols = ["expected_improvement", "realized_improvement", "overfit_underfit", "rmse_overfit_underfit_gap", "generalization"]
    return tidy(ml.log_performance(results, naive).select("prediction_run_id", "model_type", *cols))


@query(
    "m14_split_time_quantile",
    f"""WITH {FACT0} SELECT entity_id, period_id, period_id > (SELECT quantile_cont(period_id, 0.8) FROM fact0) AS is_test FROM fact0""",
)
def _(spark, d):
    train, test = ml.split_time_quantile(base_fact(spark, d).select("entity_id", "period_id"))
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


_NUMERIC = ["price", "rating_before", "price_change", "points_last_5_avg", "ppm_last_5", "momentum", "seed_last_5_avg"]
_FEATS = ml.Features(_NUMERIC, ["team_id"])


def _scaled_sql(c: str) -> str:
    filled = f"coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM raw))"
    return f"{rnd(f'({filled} - avg({filled}) OVER ()) / stddev_samp({filled}) OVER ()')} AS {c}"


@query(
    "m4_preprocessor",
    f"""WITH {FACT0}, {PRED}, raw AS (SELECT *, CASE WHEN points >= 12 THEN 'high' WHEN points >= 6 THEN 'middle' END AS class FROM pred),
place AS (SELECT class, row_number() OVER (ORDER BY count(*) DESC, class) - 1 AS i FROM raw WHERE class IS NOT NULL GROUP BY class)
SELECT entity_id, period_id, {_scaled_sql("price")}, {_scaled_sql("predicted_points")}, coalesce(i, 0)::DOUBLE AS class
FROM raw LEFT JOIN place USING (class)""",
)
def _(spark, d):
    """Numbers filled and scaled, the category filled and indexed by frequency."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    label = F.when(F.col("points") >= 12, "high").when(F.col("points") >= 6, "middle")
    feats = ml.Features(["price", "predicted_points"], ["class"])
    rows = ml.as_inputs(checkpointed(predictions(spark, d).withColumn("class", label)), feats)
    out = Pipeline(stages=ml.preprocessor(feats)).fit(rows).transform(rows)
    v = vector_to_array("__scaled")
    hot = vector_to_array("class__h")
    index = F.when(F.array_max(hot) > 0, F.array_position(hot, 1.0) - 1).cast("double")
    return tidy(out.select("entity_id", "period_id", v[0].alias("price"), v[1].alias("predicted_points"), index.alias("class")))


# Linear regressors fit in seconds; forests and boosting of the surveyed sizes do not on
# one machine, so boosting is shortened and the forest is left to the operator's tests.
_LINEAR = ["Linear", "Ridge", "Lasso", "ElasticNet"]


@query("m5_m7_fit_and_rank")
def _(spark, d):
    rows = checkpointed(entity_feature_table(spark, d))
    models = ml.make_regressors([*_LINEAR, "GradientBoosting"], rounds=10)
    results, _, _ = ml.fit_and_rank(models, rows, _FEATS, folds=5)
    return results


def _fit_sql(name: str, fitted: str, tested: str) -> str:
    """Mean absolute and root mean squared error of both models: sums over the rows fitted give the line."""
    return f"""SELECT m.model, avg(abs(y - (my + slope * (x - mx)))) AS mae, sqrt(avg(pow(y - (my + slope * (x - mx)), 2))) AS rmse
  FROM (SELECT model, avg(x) AS mx, avg(y) AS my, CASE model WHEN 'Linear' THEN covar_samp(x, y) / var_samp(x)
      ELSE covar_samp(x, y) * (count(*) - 1) / var_samp(x) / count(*) END AS slope
    FROM r, (VALUES ('Linear'), ('Ridge')) v(model) WHERE {fitted} GROUP BY model) m, r WHERE {tested} GROUP BY m.model"""


# a ridge of strength 1 on one scaled feature divides its sum of squares, n - 1, plus one: n
_CV = " UNION ALL ".join(f"SELECT * FROM ({_fit_sql('cv', f'fold < {k}', f'fold = {k}')})" for k in range(1, 6))


@query(
    "m7_linear_models",
    f"""WITH {FACT0}, o AS (SELECT price AS x, points AS y, period_id, row_number() OVER (ORDER BY season, period_id, entity_id) AS rn,
  count(*) OVER () AS n FROM fact0 WHERE points IS NOT NULL AND price IS NOT NULL),
r AS (SELECT *, CASE WHEN rn <= n - n // 6 * 5 THEN 0 ELSE 1 + (rn - (n - n // 6 * 5) - 1) // (n // 6) END AS fold,
  period_id > (SELECT period_id FROM (SELECT DISTINCT period_id FROM fact0) ORDER BY period_id DESC LIMIT 1 OFFSET 4) AS late FROM o),
cv AS ({_CV}), tr AS ({_fit_sql('train', 'NOT late', 'NOT late')}), te AS ({_fit_sql('test', 'NOT late', 'late')})
SELECT model, round(cv_mae, 4) AS cv_mae, round(cv_mae_std, 4) AS cv_mae_std, round(tr.mae, 4) AS train_mae, round(tr.rmse, 4) AS train_rmse,
  round(te.mae, 4) AS test_mae, round(te.rmse, 4) AS test_rmse
FROM (SELECT model, avg(mae) AS cv_mae, stddev_pop(mae) AS cv_mae_std FROM cv GROUP BY model) JOIN tr USING (model) JOIN te USING (model)""",
)
def _(spark, d):
    """Least squares and ridge on one feature over five expanding folds, as closed forms give them."""
    rows = checkpointed(base_fact(spark, d).where("price is not null"))
    results, _, _ = ml.fit_and_rank(ml.make_regressors(["Linear", "Ridge"]), rows, ml.Features(["price"]), folds=5)
    return results.select("model", *[F.round(c, 4).alias(c) for c in results.columns if c != "model"])


@query("m8_grid_search")
def _(spark, d):
    """All 130 candidates of the four grids over five folds."""
    train, test = ml.split_last_periods(checkpointed(entity_feature_table(spark, d)))
    return ml.grid_search(ml.default_grids(), train, test, ml.Features(_NUMERIC), folds=5)


@query("m9_m10_m11_score_and_explain")
def _(spark, d):
    """Fit, save, reload, score the last periods and list the coefficients' total beside the error."""
    rows = checkpointed(entity_feature_table(spark, d))
    train, test = ml.split_last_periods(rows)
    _, best, model = ml.fit_and_rank(ml.make_regressors(["Linear"]), train, _FEATS, folds=2)
    path = shared_folder(spark, "model")
    ml.save_model(model, {"model_name": best, "features": _FEATS.all, "asset_type": "entity"}, path)
    model, meta = ml.load_model(spark, path)
    weight = ml.coefficients(model, rows, _FEATS).agg(F.sum("abs_value").alias("weight")).scalar()
    scored = ml.score(model, test, _FEATS).select("entity_id", "period_id", "predicted_points")
    return scored.withColumns({"model_name": F.lit(meta["model_name"]), "weight": weight})


# ---------------------------------------------------------------- streams


@query(
    "x2_stream_append_new",
    """SELECT DISTINCT o_custkey, o_orderstatus FROM orders""",
)
def _(spark, d):
    home = shared_folder(spark, "stream")
    rows = read_table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    rows.repartition(4).write.parquet(f"{home}/in")
    keys = ["o_custkey", "o_orderstatus"]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
    stream_append_new(stream, f"{home}/out", keys, f"{home}/cp").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{home}/out")


def _standings_sql(period: str) -> str:
    return f"""{FACT0}, resolved AS (SELECT pool_id, season, CAST({period} AS BIGINT) AS period_id, entity_id AS entity,
  CAST(row_number() OVER (PARTITION BY pool_id, season, {period} ORDER BY round(sum(points), 4) DESC, entity_id) AS DOUBLE) AS rating_position
  FROM fact0 GROUP BY pool_id, season, {period}, entity_id)"""


def _standings(spark, d, period):
    """Positions by summed points in each season and period."""
    sums = base_fact(spark, d).groupBy("pool_id", "season", period.alias("period_id"), F.col("entity_id").alias("entity"))
    sums = sums.agg(F.round(F.sum("points"), 4).alias("points"))
    rows = number_rows(sums, ["pool_id", "season", "period_id"], ["-points", "entity"], "rating_position")
    position = F.col("rating_position").cast("double").alias("rating_position")
    return rows.select("pool_id", "season", F.col("period_id").cast("long").alias("period_id"), "entity", position)


@query("g9_sequential_rating_split", rating_sql(_standings_sql("season")))
def _(spark, d):
    """The plan for pools and periods too large for one task, over yearly standings."""
    rows = checkpointed(_standings(spark, d, F.col("season")))
    out = rt.sequential_rating(rows, "pool_id", pool_rows=0, period_rows=0)
    return out.withColumns({c: F.round(c, 4) for c in rt.RATING_COLUMNS})


@query("x1_stream_rating", rating_sql(_standings_sql("season * 10 + (period_num + 2) // 3")))
def _(spark, d):
    """Quarterly standings rated as a stream of several batches, with quarters split between them."""
    home = shared_folder(spark, "stream")
    rows = checkpointed(_standings(spark, d, F.expr("season * 10 + (period_num + 2) div 3")))
    # files in order of time, each ending inside a quarter
    files = rows.withColumn("__file", F.floor((F.col("season") * 4 + F.col("period_id") % 10 + F.col("entity") % 2) / 6))
    names = sorted(r[0] for r in files.select("__file").distinct().collect())
    for k in names:
        part = files.filter(F.col("__file") == k).drop("__file")
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    stream_rating(stream, home, "pool_id", "entity", f"{home}/cp").awaitTermination()
    closed = spark.read.parquet(f"{home}/rated").select(*rows.columns, *rt.RATING_COLUMNS)
    last = open_ratings(spark, rows.schema, home, "pool_id", "entity", len(names) - 1)
    out = closed.unionByName(last.select(*rows.columns, *rt.RATING_COLUMNS))
    return out.withColumns({c: F.round(c, 4) for c in rt.RATING_COLUMNS})
