"""The grid search's forests and boosted trees against MLlib's and against their definitions."""

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from leaguelens.catalog import QUERIES, reporting
from leaguelens.plans import models as ml
from leaguelens.plans import trees as tr


def table(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 9, n), rng.exponential(size=n), rng.integers(0, 300, n) / 7])
    return x, 2 * x[:, 0] + np.sin(3 * x[:, 2]) + x[:, 1] * x[:, 0] + rng.normal(size=n)


def both(n, train):
    x, y = table(n)
    return tr.binned(4, lambda k: x[:train, k], lambda k: x[train:, k], y[:train], y[train:], 32)


@pytest.fixture(scope="module")
def frames(spark):
    x, y = table(900)
    rows = [(*map(float, r), float(v), i < 600) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, points double, known boolean")
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3)
    return df.filter("known"), df.filter("not known")


def mae(test, values):
    return np.abs(test.y - values).mean()


def test_m8_searches_every_candidate(spark, monkeypatch):
    rows = spark.createDataFrame([(2020, p, e, 1.0) for p in range(8) for e in range(3)], "season int, period_id int, entity_id int, points double")
    seen = []
    monkeypatch.setattr(reporting, "entity_feature_table", lambda *_: rows)
    monkeypatch.setattr(ml, "grid_search", lambda grids, *_, folds: seen.append((grids, folds)))
    QUERIES["m8_grid_search"](spark, "")
    ((grids, folds),) = seen
    assert {k: len(g.candidates) for k, g in grids.items()} == {"Ridge": 5, "ElasticNet": 20, "RandomForest": 24, "GradientBoosting": 81}
    assert folds == 5
    # every one of them is grown in tasks where the rows allow it
    boosts = [(g.reg, g.of(v)(9, 1.0)) for k, g in grids.items() if k in ("RandomForest", "GradientBoosting") for v in g.candidates]
    assert all(tr.grows(reg, params, "points") for reg, params in boosts)


@pytest.mark.parametrize("depth, least", [(1, 1), (3, 5), (6, 2)])
def test_a_tree_is_that_of_mllib(frames, depth, least):
    model = DecisionTreeRegressor(labelCol="points", maxDepth=depth, minInstancesPerNode=least).fit(frames[0])
    train, test = both(900, 600)
    _, values = tr.grow(train, train.y, None, test, [depth], least, 4, 0, 32)
    assert mae(test, values[0]) == pytest.approx(ml._errors(model, frames[1], "points")[0], rel=1e-9)


def test_boosting_is_that_of_mllib_after_every_number_of_rounds(frames):
    train, test = both(900, 600)
    got = {k: mae(test, v) for k, v in tr.boosted_values(train, test, [1, 4, 9], 0.05, 3, 10, 32)}
    for rounds in (1, 4, 9):
        model = GBTRegressor(labelCol="points", maxIter=rounds, stepSize=0.05, maxDepth=3, minInstancesPerNode=10).fit(frames[0])
        assert got[rounds] == pytest.approx(ml._errors(model, frames[1], "points")[0], rel=1e-9)


def test_a_forest_errs_as_one_of_mllib(frames):
    train, test = both(900, 600)
    model = RandomForestRegressor(labelCol="points", numTrees=60, maxDepth=8, minInstancesPerNode=3, seed=201).fit(frames[0])
    values = tr.forest_sums(train, test, range(60), [8], 3, 2, 201, 32)[0] / 60
    assert mae(test, values) == pytest.approx(ml._errors(model, frames[1], "points")[0], rel=0.04)


def test_smaller_candidates_are_parts_of_larger_ones(monkeypatch):
    train, test = both(900, 600)
    whole = tr.forest_sums(train, test, range(6), [2, 5, 30], 1, 2, 7, 32)
    parts = [np.stack([tr.forest_sums(train, test, some, [d], 1, 2, 7, 32)[0] for d in (2, 5, 30)]) for some in (range(4), range(4, 6))]
    assert np.allclose(whole, sum(parts), rtol=1e-12)
    monkeypatch.setattr(tr, "CELLS_AT_ONCE", 96)  # three nodes at once
    monkeypatch.setattr(tr, "ROWS_AT_ONCE", 50)
    assert np.allclose(whole, tr.forest_sums(train, test, range(6), [2, 5, 30], 1, 2, 7, 32), rtol=1e-9)


def test_order_of_rows_does_not_matter():
    x, y = table(300)
    x[:, 3], y = 1.0, np.round(y)
    order = np.random.default_rng(1).permutation(300)
    out = []
    for rows in (np.arange(300), order):
        train, test = tr.binned(4, lambda k: x[rows, k], lambda k: x[rows, k], y[rows], y[rows], 32)  # noqa: B023
        out.append(tr.forest_sums(train, test, range(3), [9], 2, 2, 1, 32))
    assert (out[0] == out[1]).all()


@pytest.mark.parametrize("kind", ["few", "one", "hot", "even", "skewed"])
def test_thresholds_are_those_of_mllib(kind):
    rng = np.random.default_rng(2)
    values = {
        "few": rng.integers(0, 5, 200) / 2,
        "one": np.ones(50),
        "hot": np.where(rng.random(4000) < 0.6, 3.0, rng.normal(size=4000)),
        "even": np.arange(1000.0),
        "skewed": np.round(rng.exponential(size=3000) ** 3, 1),
    }[kind]
    distinct, counts = np.unique(values, return_counts=True)
    want, stride, upto, target = [], len(values) / 8, counts[0], len(values) / 8
    if len(distinct) <= 8:
        want = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    else:  # value by value, as MLlib goes
        for k in range(1, len(distinct)):
            before, upto = upto, upto + counts[k]
            if abs(before - target) < abs(upto - target):
                want.append((distinct[k - 1] + distinct[k]) / 2)
                target += stride
    assert list(tr.thresholds(values, 8)) == want and len(want) < 8


def small_grids():
    grids = ml.default_grids()
    forest, boost, ridge = (grids[k].reg for k in ("RandomForest", "GradientBoosting", "Ridge"))
    tree = lambda reg: lambda v, n, std: {reg.getParam(k): x for k, x in v.items()}
    some = [{"maxIter": m, "stepSize": s, "maxDepth": 2, "minInstancesPerNode": 5} for m in (2, 6) for s in (0.05, 0.2)]
    trees = [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": 3} for t in (30, 80) for d in (1, 4)]
    return {
        "Ridge": ml.Grid(ridge, grids["Ridge"].candidates[:2], grids["Ridge"].params),
        "RandomForest": ml.Grid(forest, trees, tree(forest)),
        "GradientBoosting": ml.Grid(boost, some, tree(boost)),
    }


def test_grid_search_in_tasks_finds_what_mllib_finds(spark, monkeypatch):
    x, y = table(480)
    rows = [(2020, i // 8, i % 8, float(a), None if i % 50 == 7 else float(b), float(v) if i % 61 else None) for i, ((a, b, *_), v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "season int, period_id int, entity_id int, a double, b double, points double").repartition(3)
    train, test = ml.split_last_periods(df)
    job = lambda: {r["model"]: r for r in ml.grid_search(small_grids(), train, test, ml.Features(["a", "b"]), folds=2).collect()}
    monkeypatch.setattr(tr, "PIECE_ROWS", 37)
    monkeypatch.setattr(tr, "TREES_AT_ONCE", 16)
    here = job()
    monkeypatch.setattr(tr, "tree_errors", None)  # the rows are too many for a task: never called
    monkeypatch.setattr(tr, "HELD_BYTES", 0)
    mllib = job()
    assert set(here) == set(mllib) == {"Ridge", "RandomForest", "GradientBoosting"}
    for name in ("Ridge", "GradientBoosting"):
        assert here[name]["best_params"] == mllib[name]["best_params"]
        for c in ("best_cv_mae", "test_mae", "test_rmse"):
            assert here[name][c] == pytest.approx(mllib[name][c], rel=1e-6)
    for c in ("best_cv_mae", "test_mae", "test_rmse"):
        assert here["RandomForest"][c] == pytest.approx(mllib["RandomForest"][c], rel=0.1)
    assert json.loads(here["RandomForest"]["best_params"])["maxDepth"] == json.loads(mllib["RandomForest"]["best_params"])["maxDepth"] == 4


def test_other_parameters_are_left_to_mllib():
    assert tr.grows(RandomForestRegressor(labelCol="points"), {}, "points")
    assert not tr.grows(RandomForestRegressor(labelCol="points", subsamplingRate=0.5), {}, "points")
    assert not tr.grows(GBTRegressor(labelCol="points", lossType="absolute"), {}, "points")
    assert not tr.grows(GBTRegressor(labelCol="points", maxBins=300), {}, "points")
    assert not tr.grows(LinearRegression(labelCol="points"), {}, "points")
