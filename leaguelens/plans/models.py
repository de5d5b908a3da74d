"""Modelling jobs on MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.aggregates import error_metrics
from leaguelens.operators.common import Order, number_rows, running_total
from leaguelens.operators.keys import next_run_id
from leaguelens.plans import trees
from leaguelens.session import checkpointed

ParamMap = dict
# Parameters of a candidate, given the number of rows fitted and their label's deviation.
Candidate = Callable[[int, float], ParamMap]
MOST_DEPTH = 30  # of a tree in MLlib

# ------------------------------------------------------------------ splits and baselines


def split_last_periods(df: DataFrame, period: str = "period_id", n: int = 4):
    """M1: (train, test) with the last ``n`` periods held out."""
    last = df.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return df.join(last, period, "left_anti"), df.join(last, period, "left_semi")


def split_hash(df: DataFrame, key: Order, frac: float = 0.2):
    """M2: (train, test) by a hash of the key, the same on every run and partitioning."""
    cols = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.filter(u >= frac), df.filter(u < frac)


def split_time_quantile(df: DataFrame, time_id: str = "period_id", q: float = 0.8):
    """(train, test) at the ``q`` quantile of time."""
    cut = df.agg(F.percentile(time_id, q).alias("cut")).scalar()
    return df.filter(F.col(time_id) <= cut), df.filter(F.col(time_id) > cut)


def naive_baseline(train: DataFrame, test: DataFrame, y: str = "points") -> DataFrame:
    """M3: errors of predicting the training mean."""
    mean = train.agg(F.avg(y).alias("m")).scalar()
    rows = test.filter(F.col(y).isNotNull()).withColumn("__pred", mean)
    out = error_metrics(rows, [], y, "__pred").select(
        F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse")
    )
    return out.withColumn("baseline", mean)


def expanding_folds(df: DataFrame, order: Order, k: int = 5) -> DataFrame:
    """M6: the fold each row is tested in; a fold trains on all rows before it.

    The last ``k`` stretches of ``n // (k + 1)`` rows are the folds 1..k; the
    rows before them are fold 0 and only train.
    """
    rows = number_rows(df, [], order, "__rn")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(n / (k + 1))
    first = n - size * k
    fold = F.when(F.col("__rn") <= first, F.lit(0)).otherwise(
        1 + F.floor((F.col("__rn") - first - 1) / size)
    )
    return rows.withColumn("fold", fold.cast("int")).drop("__rn")


# ------------------------------------------------------------------ pipelines


@dataclass
class Features:
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @staticmethod
    def of(df: DataFrame, drop: Sequence[str]) -> Features:
        """Numeric columns stay numbers, everything else becomes a category."""
        out = Features([], [])
        for f in df.schema:
            if f.name not in drop:
                (out.numeric if isinstance(f.dataType, T.NumericType) else out.categorical).append(f.name)
        return out


def as_inputs(df: DataFrame, feats: Features) -> DataFrame:
    """Columns in the types the preprocessing expects; absent ones become NULL."""
    cols = {
        c: (F.col(c) if c in df.columns else F.lit(None)).cast("double") for c in feats.numeric
    }
    cols |= {
        c: (F.col(c) if c in df.columns else F.lit(None)).cast("string") for c in feats.categorical
    }
    return df.withColumns(cols)


SKETCH = 0.001  # relative error of the ranks between which a median is looked for


def lower_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the known values, the lower of two; NaN counts as unknown.

    A sketch gives two values that enclose the median. Only the rows between them
    are counted by value, so neither the driver nor a task meets a whole column.
    """
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    rows = df.select(*[known[c].alias(c) for c in cols])
    bounds = rows.approxQuantile(list(cols), [0.5 - 2 * SKETCH, 0.5 + 2 * SKETCH], SKETCH)
    empty = [c for c, b in zip(cols, bounds, strict=True) if not b]
    if empty:
        raise ValueError(f"no value to fill {empty} with")
    near = {c: F.col(c).between(low, high) for c, (low, high) in zip(cols, bounds, strict=True)}
    counts = [F.count(c).alias(f"n{k}") for k, c in enumerate(cols)]
    counts += [F.count_if(F.col(c) < low).alias(f"b{k}") for k, (c, (low, _)) in enumerate(zip(cols, bounds, strict=True))]
    counts += [F.count_if(near[c]).alias(f"i{k}") for k, c in enumerate(cols)]
    found = rows.agg(*counts).first()
    place = {}
    for k, c in enumerate(cols):
        place[c] = (found[f"n{k}"] + 1) // 2 - found[f"b{k}"]
        if not 0 < place[c] <= found[f"i{k}"]:  # the sketch missed: count all values
            place[c], near[c] = (found[f"n{k}"] + 1) // 2, F.col(c).isNotNull()
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.when(near[c], F.col(c)).alias("value")) for c in cols])
    values = rows.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(values, "col", "value", F.col("n"), "upto")
    wanted = F.element_at(F.create_map(*[F.lit(x) for c in cols for x in (c, place[c])]), F.col("col"))
    at = upto.filter((F.col("upto") - F.col("n") < wanted) & (wanted <= F.col("upto")))
    return {r["col"]: r["value"] for r in at.select("col", "value").collect()}


class MedianFill(Estimator):
    """Fills unknown numbers with the exact median of the rows it is fitted on."""

    def __init__(self, cols: Sequence[str], names: Sequence[str]):
        super().__init__()
        self.cols, self.names = list(cols), list(names)

    def _fit(self, dataset: DataFrame) -> Model:
        median = lower_medians(dataset, self.cols)
        fills = ", ".join(
            f"CASE WHEN `{c}` IS NULL OR isnan(`{c}`) THEN CAST('{median[c]!r}' AS DOUBLE) ELSE `{c}` END AS `{name}`"
            for c, name in zip(self.cols, self.names, strict=True)
        )
        return SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__")


def preprocessor(feats: Features) -> list:
    """M4: stages: exact median fill and scaling of numbers, mode fill and one-hot categories.

    All fills are fitted with the pipeline and saved with it. The indexer orders values by
    frequency, then by name, so a blank takes index 0, the mode; a value that the fit did
    not see becomes the zero vector.
    """
    filled = [f"{c}__f" for c in feats.numeric]
    stages: list = [
        MedianFill(feats.numeric, filled),
        VectorAssembler(inputCols=filled, outputCol="__num"),
        StandardScaler(withMean=True, withStd=True, inputCol="__num", outputCol="__scaled"),
    ]
    parts = ["__scaled"]
    if feats.categorical:
        index = [f"{c}__i" for c in feats.categorical]
        known = [f"{c}__m" for c in feats.categorical]
        hot = [f"{c}__h" for c in feats.categorical]
        stages.append(StringIndexer(inputCols=feats.categorical, outputCols=index, handleInvalid="keep"))
        fills = ", ".join(f"CASE WHEN `{c}` IS NULL THEN 0.0D ELSE `{c}__i` END AS `{c}__m`" for c in feats.categorical)
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        stages.append(OneHotEncoder(inputCols=known, outputCols=hot, dropLast=True, handleInvalid="keep"))
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def penalty(reg: LinearRegression, alpha: float, l1_ratio: float, label_std: float) -> ParamMap:
    """MLlib's parameters for ``alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * |w|^2)`` beside half the mean squared error.

    MLlib divides the squared part by the label's deviation, so that deviation goes into both.
    """
    squared = (1 - l1_ratio) * (label_std or 1.0)
    total = l1_ratio + squared
    return {reg.regParam: alpha * total, reg.elasticNetParam: l1_ratio / total if total else 0.0}


def make_regressors(
    names: Sequence[str] = ("RandomForest", "GradientBoosting"),
    label: str = "points",
    n: int | None = None,
    label_std: float | None = None,
    trees: int = 500,
    rounds: int = 150,
) -> dict[str, Estimator]:
    """M5: regressors by name.

    Ridge strength follows the convention of a penalty on the sum of squares, so it
    needs the number of rows; see ``penalty`` for the label's deviation. Trees of the
    forest are unlimited in depth, as far as MLlib goes.
    """
    # The surveyed regressors' settings.
    ridge = 1.0 / (n or 1) * (label_std or 1.0)
    mixed = 0.5 + 0.5 * (label_std or 1.0)
    lin = lambda **kw: LinearRegression(labelCol=label, **kw)
    every = {
        "Linear": lin(),
        "Ridge": lin(regParam=ridge, elasticNetParam=0.0, standardization=False),
        "Lasso": lin(regParam=0.01, elasticNetParam=1.0, standardization=False, maxIter=1000),
        "ElasticNet": lin(regParam=0.01 * mixed, elasticNetParam=0.5 / mixed, standardization=False, maxIter=1000),
        "RandomForest": RandomForestRegressor(
            labelCol=label, numTrees=trees, minInstancesPerNode=5, maxDepth=MOST_DEPTH, seed=201
        ),
        "GradientBoosting": GBTRegressor(
            labelCol=label, maxIter=rounds, stepSize=0.03, maxDepth=3, minInstancesPerNode=20, seed=201
        ),
    }
    return {name: every[name] for name in names}


def surveyed_penalty(name: str, reg: Estimator) -> Candidate | None:
    """The penalty of a regressor by name, worked out from the rows it is fitted on."""
    # Strength and share of the absolute part.
    known = {"Ridge": lambda n: (1.0 / n, 0.0), "ElasticNet": lambda n: (0.01, 0.5)}
    if name not in known or not isinstance(reg, LinearRegression):
        return None
    return lambda n, std: penalty(reg, *known[name](n), std)


def _errors(model: Model, df: DataFrame, label: str) -> tuple[float, float]:
    row = error_metrics(model.transform(df), [], label, "prediction").first()
    return row["mae"], row["rmse"]


class Training:
    """Rows made ready once for every regressor: preprocessing fitted on them, their features kept."""

    def __init__(self, feats: Features, rows: DataFrame, label: str):
        self.label = label
        self.ready = Pipeline(stages=preprocessor(feats)).fit(rows)
        self.rows = self.inputs(rows)
        self.n, std = self.rows.agg(F.count(label), F.stddev_samp(label)).first()
        self.std = std or 1.0

    def inputs(self, rows: DataFrame) -> DataFrame:
        return self.ready.transform(rows).select("features", self.label).persist()

    def fit(self, reg: Estimator, candidate: Candidate | None) -> Model:
        """Fit under a candidate, whose parameters may depend on the rows fitted."""
        return reg.fit(self.rows, {} if candidate is None else candidate(self.n, self.std))

    def width(self) -> int:
        return len(self.rows.first()["features"])

    def whole(self, model: Model) -> PipelineModel:
        return PipelineModel([*self.ready.stages, model])


def _each(parallel: int, job: Callable, items: Sequence) -> list:
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(job, items))


def _mean_and_deviation(scores: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
    """Over the folds, of every regressor; ``scores`` has one row per fold."""
    means = [sum(of) / len(of) for of in zip(*scores, strict=True)]
    return [(m, (sum((x - m) ** 2 for x in of) / len(of)) ** 0.5) for m, of in zip(means, zip(*scores, strict=True), strict=True)]


def cross_validate(
    feats: Features,
    folded: DataFrame,
    label: str,
    tried: Sequence[tuple[Estimator, Candidate | None]],
    parallel: int = 2,
    see: Callable[[Training, DataFrame], None] | None = None,
) -> list[tuple[float, float]]:
    """Mean and population deviation of the MAE over expanding folds, of every regressor tried.

    A fold's preprocessing does not depend on the regressor, so it is fitted once a fold;
    ``see`` is shown each fold's rows fitted and tested as well.
    """
    top = folded.agg(F.max("fold")).first()[0]
    scores = []
    for i in range(1, top + 1):
        fitted = Training(feats, folded.filter(F.col("fold") < i), label)
        tested = fitted.inputs(folded.filter(F.col("fold") == i))
        scores.append(_each(parallel, lambda item: _errors(fitted.fit(*item), tested, label)[0], tried))  # noqa: B023
        if see is not None:
            see(fitted, tested)
        fitted.rows.unpersist()
        tested.unpersist()
    return _mean_and_deviation(scores)


RESULTS = (
    "model string, cv_mae double, cv_mae_std double, train_mae double, train_rmse double, "
    "test_mae double, test_rmse double"
)


def _folded(rows: DataFrame, feats: Features, label: str, order: Order, folds: int, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that are fitted on, with their folds, written once."""
    return checkpointed(expanding_folds(rows, order, folds).select(*dict.fromkeys([*feats.all, label, *keep, "fold"])))


def fit_and_rank(
    models: dict[str, Estimator],
    df: DataFrame,
    feats: Features,
    label: str = "points",
    order: Order = ("season", "period_id", "entity_id"),
    folds: int = 5,
    test_periods: int = 4,
    parallel: int = 2,
):
    """M7: cross-validate and test each model; returns (results, best name, best model).

    The best model by cross-validated MAE is refitted on all rows. Ridge and ElasticNet by
    these names take their penalty from the rows of each fit, never from those tested.
    """
    spark = df.sparkSession
    folded = _folded(as_inputs(df.filter(F.col(label).isNotNull()), feats), feats, label, order, folds, ["period_id"])
    tried = [(reg, surveyed_penalty(name, reg)) for name, reg in models.items()]
    scores = cross_validate(feats, folded, label, tried, parallel)
    train, test = split_last_periods(folded, n=test_periods)
    fitted = Training(feats, train, label)
    tested = fitted.inputs(test)

    def run(item):
        model = fitted.fit(*item)
        return (*_errors(model, fitted.rows, label), *_errors(model, tested, label))

    errors = _each(parallel, run, tried)
    fitted.rows.unpersist()
    tested.unpersist()
    results = sorted(((name, *cv, *e) for name, cv, e in zip(models, scores, errors, strict=True)), key=lambda r: r[1])
    best = results[0][0]
    every = Training(feats, folded, label)
    model = every.whole(every.fit(models[best], surveyed_penalty(best, models[best])))
    every.rows.unpersist()
    return spark.createDataFrame(results, RESULTS), best, model


@dataclass
class Grid:
    """An estimator, its candidates by the names they are reported under, and how one becomes parameters."""

    reg: Estimator
    candidates: list[dict]
    params: Callable[[dict, int, float], ParamMap]

    def of(self, values: dict) -> Candidate:
        return lambda n, std: self.params(values, n, std)


def default_grids(label: str = "points") -> dict[str, Grid]:
    """Parameter grids of the search: 5, 20, 24 and 81 candidates."""
    ridge = LinearRegression(labelCol=label, standardization=False)
    net = LinearRegression(labelCol=label, standardization=False, maxIter=1000)
    forest = RandomForestRegressor(labelCol=label, seed=201)
    boost = GBTRegressor(labelCol=label, seed=201)

    def cross(**values) -> list[dict]:
        return [dict(zip(values, found, strict=True)) for found in product(*values.values())]

    def tree(reg):
        return lambda values, n, std: {reg.getParam(k): v for k, v in values.items()}

    # The surveyed grids.
    return {
        # a penalty on the sum of squares, hence divided by the rows
        "Ridge": Grid(
            ridge, cross(alpha=[0.01, 0.1, 1.0, 10.0, 100.0]), lambda v, n, std: penalty(ridge, v["alpha"] / n, 0.0, std)
        ),
        "ElasticNet": Grid(
            net,
            cross(alpha=[0.001, 0.01, 0.1, 1.0], l1_ratio=[0.1, 0.3, 0.5, 0.7, 0.9]),
            lambda v, n, std: penalty(net, v["alpha"], v["l1_ratio"], std),
        ),
        "RandomForest": Grid(
            forest,
            cross(numTrees=[300, 500], maxDepth=[8, 12, 20, MOST_DEPTH], minInstancesPerNode=[1, 3, 5]),
            tree(forest),
        ),
        "GradientBoosting": Grid(
            boost,
            cross(maxIter=[100, 200, 400], stepSize=[0.02, 0.03, 0.05], maxDepth=[3, 4, 5], minInstancesPerNode=[5, 10, 20]),
            tree(boost),
        ),
    }


def grid_search(
    grids: dict[str, Grid],
    train: DataFrame,
    test: DataFrame,
    feats: Features,
    label: str = "points",
    order: Order = ("season", "period_id", "entity_id"),
    folds: int = 5,
    parallel: int = 4,
):
    """M8: best candidate per model by expanding-fold MAE, tested once.

    Candidates run as concurrent Spark jobs over the features of a fold, made once for all.
    Where the rows fit a task, all forests and boosted trees of all folds are grown by one more
    job, inside its tasks (``trees``); else MLlib grows them over the cluster, candidate by candidate.
    """
    spark = train.sparkSession
    ready = lambda df: as_inputs(df.filter(F.col(label).isNotNull()), feats)
    folded = _folded(ready(train), feats, label, order, folds)
    fitted = Training(feats, folded, label)
    tested = fitted.inputs(ready(test))
    small = trees.fits_task(fitted.n, fitted.width())

    def in_tasks(name: str, values: dict) -> bool:
        reg = grids[name].reg
        return small and trees.grows(reg, grids[name].of(values)(fitted.n, fitted.std), label)

    tried = [(name, values) for name, grid in grids.items() for values in grid.candidates]
    grown = [t for t in tried if in_tasks(*t)]
    fits = [t for t in tried if t not in grown]
    shown: list[trees.Fold] = []

    def fold(of: Training, over: DataFrame, some: Sequence[tuple[str, dict]]) -> trees.Fold:
        files = [trees.write_rows(df, of.width(), label) for df in (of.rows, over)]
        return trees.Fold(*files, of.n, of.width(), [(grids[name].reg, grids[name].of(values)(of.n, of.std)) for name, values in some])

    see = (lambda of, over: shown.append(fold(of, over, grown))) if grown else None
    scores = cross_validate(feats, folded, label, [(grids[name].reg, grids[name].of(values)) for name, values in fits], parallel, see)
    means = [s[0] for s in scores]
    if grown:
        errors = trees.tree_errors(spark, shown)
        means += [m for m, _ in _mean_and_deviation([[mae for mae, _ in of] for of in errors])]
    best: dict[str, tuple[float, dict]] = {}
    for (name, values), mean in zip([*fits, *grown], means, strict=True):
        best[name] = min(best.get(name, (mean, values)), (mean, values), key=lambda x: x[0])
    last = [(name, best[name][1]) for name in grids if in_tasks(name, best[name][1])]
    final = dict(zip([name for name, _ in last], trees.tree_errors(spark, [fold(fitted, tested, last)])[0], strict=True)) if last else {}
    out = []
    for name in grids:
        mean, values = best[name]
        mae, rmse = final[name] if name in final else _errors(fitted.fit(grids[name].reg, grids[name].of(values)), tested, label)
        out.append((name, mean, mae, rmse, json.dumps(values, sort_keys=True)))
    for df in (fitted.rows, tested):
        df.unpersist()
    out.sort(key=lambda r: r[1])
    schema = "model string, best_cv_mae double, test_mae double, test_rmse double, best_params string"
    return spark.createDataFrame(out, schema)


# ------------------------------------------------------------------ use of a model


def score(model: PipelineModel, frame: DataFrame, feats: Features) -> DataFrame:
    """M9: predictions for a scoring frame; absent columns count as blank."""
    inputs = {c: F.col(c) for c in frame.columns}
    keep = [c for c in frame.columns if c not in ("points",)]
    scored = model.transform(as_inputs(frame, feats).withColumns({f"__k_{c}": inputs[c] for c in keep}))
    return scored.select(
        *[F.col(f"__k_{c}").alias(c) for c in keep], F.col("prediction").alias("predicted_points")
    )


def coefficients(model: PipelineModel, sample: DataFrame, feats: Features) -> DataFrame:
    """Coefficients or importances by feature, largest first."""
    names = list(feats.numeric)
    indexer = next((x for x in model.stages if isinstance(x, StringIndexerModel)), None)
    if indexer is not None:
        names += [f"{c}={v}" for c, values in zip(feats.categorical, indexer.labelsArray, strict=True) for v in values]
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values.toArray(), strict=True)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    return sample.sparkSession.createDataFrame(rows, "feature string, value double, abs_value double")


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    """Model and its metadata row, both through Spark's file system."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    row = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    """What ``save_model`` wrote."""
    meta = spark.read.text(f"{path}/meta").first()[0]
    return PipelineModel.load(f"{path}/model"), json.loads(meta)


def log_predictions(df: DataFrame, runs: DataFrame, meta: dict[str, object], created_at):
    """(run row, prediction rows) under the next run id.

    ``created_at`` is a parameter, so that a repeated run logs the same rows.
    """
    run_id = next_run_id(runs, "prediction_run_id").select(F.col("next_prediction_run_id").alias("prediction_run_id"))
    cols = {k: F.lit(v) for k, v in meta.items()}
    run = run_id.withColumns({"created_at": F.lit(created_at).cast("timestamp"), **cols})
    rows = df.withColumns(
        {
            "prediction_run_id": run_id.scalar(),
            "prediction_timestamp": F.lit(created_at).cast("timestamp"),
            **cols,
        }
    )
    return run, rows


def log_performance(results: DataFrame, naive: DataFrame) -> DataFrame:
    """Improvement over the run's naive baseline and over-/underfit gaps."""
    base = naive.select("prediction_run_id", F.col("test_mae").alias("__mae"))
    rows = results.join(base, "prediction_run_id", "left")
    c = F.col
    return rows.withColumns(
        {
            "expected_improvement": F.try_divide(c("__mae") - c("cv_mae"), c("__mae")),
            "realized_improvement": F.try_divide(c("__mae") - c("test_mae"), c("__mae")),
            "overfit_underfit": c("test_mae") - c("train_mae"),
            "rmse_overfit_underfit_gap": c("test_rmse") - c("train_rmse"),
            "generalization": c("test_mae") - c("cv_mae"),
        }
    ).drop("__mae")
