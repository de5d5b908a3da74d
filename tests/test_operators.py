"""Small frames with the awkward cases: NULLs, ties, single rows, zero prices, blanks."""

import math
import pathlib
import random
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaguelens.functions import scalars as fx
from leaguelens.operators import aggregates as ag
from leaguelens.operators import joins as jn
from leaguelens.operators import keys as ky
from leaguelens.operators import ordering as od
from leaguelens.operators import quality as ql
from leaguelens.operators import reshape as rs
from leaguelens.operators import sets as se
from leaguelens.operators import windows as wn
from leaguelens.plans import features as fe
from leaguelens.plans import models as ml
from leaguelens.plans import outcomes as oc
from leaguelens.plans import staging as sg
from leaguelens.sources import landing as ld
from leaguelens.sources import tables as tb
from leaguelens.operators.ordering import one_per_key
from leaguelens.plans.outcomes import draw_index
from leaguelens.sources.tables import read_or_empty
from leaguelens.streaming.append_stream import stream_append_new


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_vs_partner_needs_exactly_two_values(spark):
    df = spark.createDataFrame(
        [(1, "a", 3), (1, "b", 7), (2, "a", 5), (3, "a", 1), (3, "b", None), (4, "a", 1), (4, "b", 2), (4, "c", 3)],
        "team int, e string, q int",
    )
    out = {(r["team"], r["e"]): r["q_vs_partner"] for r in wn.vs_partner(df, "team", "q").collect()}
    assert out[(1, "a")] == -4 and out[(1, "b")] == 4
    assert all(v is None for k, v in out.items() if k[0] != 1)


def test_zero_price_gives_null_ratio(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0)], "e int, t int, price double")
    out = rows(wn.change_and_pct(df, "e", "t", "price"), "t", "price_change", "price_change_pct")
    assert out == [(1, None, None), (2, 5.0, None)]


def test_entity_features_defaults(spark):
    df = spark.createDataFrame(
        [(2020, 1, 1, 9, 10.0, 5.0, 1500.0, None, True), (2020, 2, 1, 9, 0.0, None, 1500.0, 4, False), (2020, 3, 1, 9, 8.0, 6.0, 1500.0, 2, False)],
        "season int, period_id int, entity_id int, team_id int, price double, points double, rating_before double, seed_position int, is_special boolean",
    ).withColumn("date_start", F.col("period_id"))
    out = {r["period_id"]: r for r in fe.entity_features(df).collect()}
    assert out[1]["points_last_5_avg"] == 0 and out[1]["seed_last_5_avg"] == 20 and out[1]["price_increase"] == 0
    assert out[2]["price_decrease"] == 1 and out[2]["ppm_last_5"] == 0  # price zero
    assert out[3]["points_last_5_avg"] == 5 and out[3]["price_change_pct"] == 0 and out[3]["seed_last_5_avg"] == 4
    assert out[3]["partner_points_last_5"] == 0 and out[3]["partner_delta_last_5"] == 5 - 0


def test_best_row_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("a", 5, 3), ("b", None, 4)], "k string, t int, v int")
    assert rows(od.best_row(df, "k", "t"), "k", "v") == [("a", 2), ("b", 4)]
    assert rows(od.best_row(df, "k", "-t"), "k", "v") == [("a", 3), ("b", 4)]
    with pytest.raises(ValueError):
        od.best_row(df, "k", ["t", "-v"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=25))
def test_trailing_mean_property(spark, data):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(data)], "k string, t int, v int")
    got = {r["t"]: r["v_last_3_avg"] for r in wn.trailing_mean(df, "k", "t", "v", 3).collect()}
    for i, (k, _) in enumerate(data):
        past = [v for kk, v in data[:i] if kk == k][-3:]
        past = [v for v in past if v is not None]
        assert got[i] == (pytest.approx(sum(past) / len(past)) if past else None)


def test_join_one_to_one_raises(spark):
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    two = spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    assert jn.join_one_to_one(one, two.limit(1), "k").count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        jn.join_one_to_one(one, two, "k")


def test_join_normalized_and_grain_safe(spark):
    a = spark.createDataFrame([(1, "  ABC "), (2, None)], "id int, name string")
    b = spark.createDataFrame([("abc", 9), (None, 8)], "label string, v int")
    assert rows(jn.join_normalized(a, b, {"name": "label"}), "id", "v") == [(1, 9), (2, None)]
    many = spark.createDataFrame([(1, 1), (1, 2)], "id int, x int")
    assert jn.join_grain_safe(a, many, "id", {"x": F.max("x")}).count() == 2


def test_union_priority_and_column_diff(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(se.union_priority([a, b], "k"), "k", "v") == [(1, "a"), (2, "b")]
    assert se.column_diff(a, b.withColumnRenamed("v", "w")) == {"missing": ["v"], "extra": ["w"]}


def test_keys_stay_stable(spark):
    first = spark.createDataFrame([("b",), ("a",)], "name string")
    dim = ky.assign_keys(first, "name", "name", "id")
    later = spark.createDataFrame([("c",), ("a",), ("aa",)], "name string")
    once = ky.extend_keys(later, dim, "name", "name", "id")
    assert rows(once, "name", "id") == [("a", 1), ("aa", 3), ("b", 2), ("c", 4)]
    assert rows(ky.extend_keys(later, once, "name", "name", "id")) == rows(once)
    empty = dim.limit(0)
    assert rows(ky.extend_keys(first, empty, "name", "name", "id"), "name", "id") == [("a", 1), ("b", 2)]


def test_overrides_replace_only_where_given(spark):
    base = spark.createDataFrame([(1, False, 5.0), (2, False, 6.0)], "k int, dsq boolean, position double")
    over = spark.createDataFrame([(1, True, None)], "k int, dsq_override boolean, position_override double")
    out = ky.apply_overrides(base, over, "k", {"dsq": "dsq_override", "position": "position_override", "dns": "dns_override"})
    assert rows(out, "k", "dsq", "position") == [(1, True, 5.0), (2, False, 6.0)]
    assert out.columns == ["k", "dsq", "position"]


def test_max_or(spark):
    df = spark.createDataFrame([], "id long")
    assert ag.max_or(df, "id", 0).first()[0] == 0
    with pytest.raises(ValueError):
        ag.max_strict(df, "id")


def test_dist_summary_single_row_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 1.0), ("c", 3.0)], "k string, v double")
    for limit in (100, 0):
        out = {r["k"]: r for r in ag.dist_summary(df, "k", "v", max_group_rows=limit).collect()}
        assert (out["a"]["n"], out["a"]["median"], out["a"]["std_v"]) == (1, 1.0, None)
        assert (out["b"]["n"], out["b"]["median"]) == (0, None)
        assert (out["c"]["median"], out["c"]["p25"]) == (2.0, 1.5)


def test_string_agg_parts(spark):
    df = spark.createDataFrame([("a", x) for x in ("q", "p", None, "q", "r")] + [("b", None)], "k string, v string")
    assert rows(ag.string_agg(df, "k", "v"), "k", "part", "v_list") == [("a", 0, "p, q, r"), ("b", 0, None)]
    assert rows(ag.string_agg(df, "k", "v", part_size=2), "k", "part", "v_list") == [("a", 0, "p, q"), ("a", 1, "r"), ("b", 0, None)]
    assert rows(ag.string_agg(df, "k", "v", part_size=3), "k", "part", "v_list") == [("a", 0, "p, q, r"), ("b", 0, None)]


def test_bucketize_and_flags(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.9, 5.0, 20.0, None)], "v double")
    got = [r[0] for r in df.select(rs.bucketize(F.col("v"), *oc.REPORT_BANDS)).collect()]
    assert got == ["< 0", "0-5", "0-5", "5-10", "20+", None]
    text = spark.createDataFrame([("Retired",), (None,), ("Withdrew",)], "status string")
    flags = rows(rs.status_flags(text, "status", sg.STATUS_GROUPS), "status", "dnf", "dns", "dsq")
    assert flags == [("Retired", 1, 0, 0), ("Withdrew", 0, 1, 0), (None, 0, 0, 0)]


def test_null_position_flag(spark):
    raw = spark.createDataFrame(
        [(1, 1, 1, 2020, "R", " Guanyu Zhou", "T ", None, "R", "Retired", None)],
        "period_id int, meeting_key int, session_key int, season int, period_name string, full_name string, team_name string, "
        "position double, classified_position string, status string, grid_position double",
    )
    assert rows(sg.stage_placements(raw), "entity", "team", "finish_position") == [("zhou guanyu", "t", None)]
    assert rows(sg.stage_placements(raw, null_position_as_zero=True), "finish_position", "grid_position") == [(0.0, 0.0)]


def test_scalars(spark):
    df = spark.createDataFrame([("2023Driver", [1.0, None], float("nan"), 2.5)], "s string, a array<double>, x double, h double")
    r = df.select(
        fx.prefix_int(F.col("s"), 4).alias("y"),
        fx.prefix_int(F.lit("abcd"), 4).alias("bad"),
        fx.element(F.col("a"), 1).alias("null_el"),
        fx.element(F.col("a"), 5).alias("past"),
        fx.nan_to_null(F.col("x")).alias("nan"),
        fx.round_half_even(F.col("h"), 0).alias("even"),
        fx.round_half_up(F.col("h"), 0).alias("up"),
        fx.safe_divide(F.col("h"), F.lit(0.0)).alias("div"),
        fx.matches(F.lit(None).cast("string"), "x").alias("m"),
        fx.parse_ts_fmt(F.lit("3/6/2026 23:30")).cast("string").alias("ts"),
        fx.map_values(F.lit("q"), {}).alias("same"),
    ).first()
    assert tuple(r) == (2023, None, None, None, None, 2.0, 3.0, None, False, "2026-03-06 23:30:00", "q")


def test_bootstrap_draws_from_its_bucket_and_raises_without_one(spark):
    res = spark.createDataFrame(
        [("00_20", float(i), i, 1) for i in range(7)] + [("20_plus", 100.0 + i, i, 2) for i in range(5)],
        "prediction_bucket string, residual double, period_id long, entity_id long",
    )
    scores = spark.createDataFrame(
        [(1, 1, 10.0, "00_20"), (1, 2, 30.0, "20_plus"), (1, 3, None, None)],
        "period_id long, entity_id long, predicted_points double, prediction_bucket string",
    )
    sims = oc.bootstrap_outcomes(scores, res, 500)
    assert sims.count() == 1000
    assert rows(sims) == rows(oc.bootstrap_outcomes(scores.repartition(3), res, 500, max_group_rows=2))
    got = {r["entity_id"]: set(r["s"]) for r in sims.groupBy("entity_id").agg(F.collect_set("sampled_residual").alias("s")).collect()}
    assert got == {1: {float(i) for i in range(7)}, 2: {100.0 + i for i in range(5)}}
    with pytest.raises(KeyError):
        oc.bootstrap_outcomes(scores, res.filter("prediction_bucket = '00_20'"), 10)


def test_quality_suite(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 1, 5.0), (2, 1, 99.0)], "k int, g int, v double")
    spec = {
        "t": {"columns": ["k", "w"], "not_null": ["v"], "grain": ["k"], "range": {"v": (0, 10)}, "coverage": ("g", "k", 3), "resolved": ["v"]},
        "u": {},
    }
    out = {(r["table_name"], r["check_name"]): r["n_bad"] for r in ql.run_suite({"t": df}, spec).collect()}
    assert out == {
        ("u", "exists"): 1, ("t", "required_column"): 3, ("t", "not_null"): 1, ("t", "grain"): 1,
        ("t", "range"): 1, ("t", "coverage"): 1, ("t", "resolved"): 1,
    }
    with pytest.raises(ValueError, match="grain"):
        ql.raise_if_any(ql.check_grain(df, "k"), "grain")
    ql.raise_if_any(ql.check_grain(df, ["k", "v"]), "grain")


def test_files(spark):
    home = tempfile.mkdtemp(prefix="leaguelens-files-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tb.overwrite_table(df, f"{home}/t")
    tb.append_new_only(spark.createDataFrame([(2, "z"), (3, "c"), (3, "c")], df.schema), f"{home}/t", "k")
    tb.append_new_only(spark.createDataFrame([(3, "c")], df.schema), f"{home}/t", "k")
    held = spark.read.schema(df.schema).parquet(f"{home}/t")
    assert rows(held) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(tb.replace_slice(held, spark.createDataFrame([(9, "p")], df.schema), "k = 1 OR v IS NULL")) == [(2, "b"), (3, "c"), (9, "p")]
    with open(f"{home}/log.csv", "w") as f:
        f.write("Unnamed: 0,id,created_at\n0,7,3/6/2026 23:30\n1,8,never\n")
    log = ld.read_csv(spark, f"{home}/log.csv", times=["created_at"])
    assert log.columns == ["id", "created_at"]
    assert [str(r["created_at"]) for r in log.orderBy("id").collect()] == ["2026-03-06 23:30:00", "None"]
    with open(f"{home}/page.json", "w") as f:
        f.write('[{"a": 1, "b": [1.5, null]}, {"a": 2}]')
    assert rows(ld.read_json_landing(spark, f"{home}/page.json", "a int, b array<double>"), "a") == [(1,), (2,)]
    (tmp := pathlib.Path(f"{home}/pages")).mkdir()
    for i in range(3):
        (tmp / f"{i}.json").write_text(f'[{{"a": {i}}}, {{"a": {i + 1}}}]')
    pages = ld.stream_json_landing(spark, str(tmp), "a int", files_per_batch=1)
    stream_append_new(pages, f"{home}/seen", "a", f"{home}/cp").awaitTermination()
    assert rows(spark.read.schema("a int").parquet(f"{home}/seen")) == [(0,), (1,), (2,), (3,)]
    with open(f"{home}/sheet.csv", "w") as f:
        f.write("Driver,1.0, 2 ,Unnamed: 3,Total Points\nx,5,,,7\n")
    out = ld.read_wide_sheets(spark, {"2024DriverPoints": f"{home}/sheet.csv"}, "entity", "period", "points")
    assert rows(out) == [("x", "1", 5.0, "2024DriverPoints"), ("x", "2", None, "2024DriverPoints"), ("x", "total_points", 7.0, "2024DriverPoints")]


def test_stream_append_new_matches_batch(spark):
    home = tempfile.mkdtemp(prefix="leaguelens-stream-")
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 30), rng.randint(0, 3)) for _ in range(200)], "a int, b int")
    df.repartition(5).write.parquet(f"{home}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
    stream_append_new(source, f"{home}/out", ["a", "b"], f"{home}/cp").awaitTermination()
    assert rows(spark.read.schema(df.schema).parquet(f"{home}/out")) == rows(df.distinct())


def test_a_broken_target_is_not_an_empty_one(spark):
    home = tempfile.mkdtemp(prefix="leaguelens-test-")
    schema = spark.createDataFrame([], "a int").schema
    assert read_or_empty(spark, f"{home}/none", schema).count() == 0
    with pytest.raises(Exception, match="(?i)cannot|unsupported|not"):
        read_or_empty(spark, f"nowhere://{home}", schema).count()


def test_survivors_do_not_depend_on_the_order_of_rows(spark):
    data = [(1, "b", 2), (1, "a", 9), (2, None, 1), (1, "a", 3)]
    for part in (data, data[::-1]):
        assert rows(one_per_key(spark.createDataFrame(part, "k int, s string, n int"), "k")) == [(1, "a", 3), (2, None, 1)]


@pytest.mark.parametrize("size", [1_000, 1_000_000_000, 4_000_000_000])
def test_draws_are_uniform_at_any_size(spark, size):
    import numpy as np

    sims = spark.range(200).select(F.col("id").alias("sim")).crossJoin(spark.range(1000).select((F.col("id") * 613 + 199901).alias("key")))
    drawn = sims.select("sim", "key", draw_index(F.col("key"), F.col("sim"), 42, F.lit(size).cast("long")).alias("i")).toPandas()
    u = np.sort((drawn["i"].to_numpy() + 0.5) / size)
    assert 0 <= u[0] and u[-1] < 1
    gap = np.abs(u - (np.arange(len(u)) + 0.5) / len(u)).max()
    assert gap < 1.95 / np.sqrt(len(u)) + 1 / size  # Kolmogorov-Smirnov at one in a thousand
    # neither entities nor simulations draw in step
    table = drawn.pivot(index="key", columns="sim", values="i").to_numpy(float)
    assert abs(np.corrcoef(table[:-1].ravel(), table[1:].ravel())[0, 1]) < 0.01
    assert abs(np.corrcoef(table[:, :-1].ravel(), table[:, 1:].ravel())[0, 1]) < 0.01


def test_ridge_matches_the_closed_form(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    x, alpha = rng.normal(size=60), 1.0
    y = 9 * x + rng.normal(size=60)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, points double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    reg = ml.make_regressors(["Ridge"], n=60, label_std=float(np.std(y, ddof=1)))["Ridge"]
    xc, yc = x - x.mean(), y - y.mean()
    assert reg.fit(df).coefficients[0] == pytest.approx((xc @ yc) / (xc @ xc + alpha), rel=2e-3)


def test_elastic_net_matches_its_definition(spark):
    """Coordinate descent by hand on one feature: soft threshold over curvature plus the squared part."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(4)
    x = rng.normal(size=80)
    y = 7 * x + rng.normal(size=80)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, points double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    xc, yc = x - x.mean(), y - y.mean()
    for name, values in [("Ridge", {"alpha": 100.0}), ("ElasticNet", {"alpha": 1.0, "l1_ratio": 0.3})]:
        grid = ml.default_grids()[name]
        alpha, ratio = (values["alpha"] / 80, 0.0) if name == "Ridge" else (values["alpha"], values["l1_ratio"])
        want = (xc @ yc / 80 - alpha * ratio) / (xc @ xc / 80 + alpha * (1 - ratio))
        model = grid.reg.fit(df, grid.of(values)(80, float(np.std(y, ddof=1))))
        assert model.coefficients[0] == pytest.approx(want, rel=5e-3)
    sizes = {k: len(g.candidates) for k, g in ml.default_grids().items()}
    assert sizes == {"Ridge": 5, "ElasticNet": 20, "RandomForest": 24, "GradientBoosting": 81}


def test_a_blank_category_scores_as_the_mode(spark, tmp_path):
    data = [(float(i % 7), "a" if i % 3 else "b", 2.0 * (i % 7) + (5.0 if i % 3 else 0.0)) for i in range(120)]
    df = spark.createDataFrame(data, "x double, c string, points double")
    feats = ml.Features(["x"], ["c"])
    from pyspark.ml import Pipeline

    reg = ml.make_regressors(["Linear"])["Linear"]
    model = Pipeline(stages=[*ml.preprocessor(feats), reg]).fit(ml.as_inputs(df, feats))
    ml.save_model(model, {"features": feats.all}, f"file://{tmp_path}")
    model, _ = ml.load_model(spark, f"file://{tmp_path}")
    new = spark.createDataFrame([(3.0, "a"), (3.0, None), (3.0, "b"), (3.0, "zzz")], "x double, c string")
    a, blank, b, unseen = [r["predicted_points"] for r in ml.score(model, new, feats).collect()]
    assert blank == pytest.approx(a) and abs(a - b) > 4 and unseen not in (a, b)
    names = {r["feature"] for r in ml.coefficients(model, df, feats).collect()}
    assert names == {"x", "c=a", "c=b"}


def test_expanding_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "t int")
    got = [r["fold"] for r in ml.expanding_folds(df, "t", 5).orderBy("t").collect()]
    assert got == [0] * 8 + [f for f in range(1, 6) for _ in range(3)]


def test_unseen_category_is_the_zero_vector(spark):
    from pyspark.ml import Pipeline

    feats = ml.Features(["x"], ["c"])
    train = ml.as_inputs(spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "x double, c string"), feats)
    model = Pipeline(stages=ml.preprocessor(feats)).fit(train)
    new = ml.as_inputs(spark.createDataFrame([(2.0, "zzz")], "x double, c string"), feats)
    v = model.transform(new).first()["features"].toArray()
    assert list(v[1:]) == [0.0] * (len(v) - 1)


def test_history_before(spark):
    df = spark.createDataFrame([(2020, 9), (2021, 1), (2021, 2), (2022, 1)], "season int, period_num int")
    assert rows(fe.history_before(df, 2021, 2)) == [(2020, 9), (2021, 1)]


def test_skewness_is_the_corrected_one(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 9.0)], "v double")
    m = 4.0
    g1 = sum((x - m) ** 3 for x in (1, 2, 9)) / 3 / (sum((x - m) ** 2 for x in (1, 2, 9)) / 3) ** 1.5
    assert tb.column_profile(df).first()["skew"] == pytest.approx(g1 * math.sqrt(6) / 1)


def test_every_regressor_fits_and_explains(spark):
    rng = random.Random(2)
    data = [(2020 + i // 40, i // 4, i, rng.random(), rng.choice("ab")) for i in range(160)]
    df = spark.createDataFrame(data, "season int, period_id int, entity_id int, x double, c string")
    df = df.withColumn("points", 3 * F.col("x") + F.when(F.col("c") == "a", 1.0).otherwise(0.0)).repartition(2)
    feats = ml.Features.of(df, ["points", "season", "period_id", "entity_id"])
    assert feats == ml.Features(["x"], ["c"])
    names = ["Linear", "Ridge", "Lasso", "ElasticNet", "RandomForest", "GradientBoosting"]
    models = ml.make_regressors(names, n=160, label_std=1.0, trees=5, rounds=3)
    results, best, model = ml.fit_and_rank(models, df, feats, folds=1, parallel=3)
    ranked = [r["model"] for r in results.collect()]
    assert sorted(ranked) == sorted(names) and best == ranked[0]
    top = ml.coefficients(model, df, feats).collect()
    assert top[0]["feature"] == "x" and [r["abs_value"] for r in top] == sorted((r["abs_value"] for r in top), reverse=True)
    scored = ml.score(model, df.drop("points", "c"), feats)
    assert scored.count() == 160 and "predicted_points" in scored.columns


def test_medians_are_the_lower_and_exact(spark, monkeypatch):
    rng = random.Random(5)
    data = [(rng.choice([None, float("nan"), rng.gauss(0, 9)]), float(i % 3), float(-i)) for i in range(999)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    known = [sorted(v for v in of if v is not None and v == v) for of in zip(*data, strict=True)]
    want = {c: of[(len(of) - 1) // 2] for c, of in zip("abc", known, strict=True)}
    assert ml.lower_medians(df, ["a", "b", "c"]) == want
    monkeypatch.setattr(ml, "SKETCH", 0.0)
    assert ml.lower_medians(df, ["a", "b", "c"]) == want


def test_preprocessing_is_fitted_once_a_fold(spark, monkeypatch):
    df = spark.createDataFrame([(2020, i // 10, i, float(i % 7), float(i % 5)) for i in range(120)], "season int, period_id int, entity_id int, x double, points double")
    calls = []
    found = ml.lower_medians
    monkeypatch.setattr(ml, "lower_medians", lambda *a: calls.append(1) or found(*a))
    ml.fit_and_rank(ml.make_regressors(["Linear", "Lasso"]), df, ml.Features(["x"]), folds=2)
    assert len(calls) == 4  # two folds, the test and the last fit, whatever the number of models
