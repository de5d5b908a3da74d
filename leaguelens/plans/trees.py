"""Errors of many forests and boosted trees over the same rows (M8).

The rows of a fold are files of the shared folder; a task reads them, keeps each feature as the byte of
its bin, and grows trees by the rules of MLlib: the same bins, from all rows where MLlib looks at a sample,
the same gain, least rows and means. Candidates that differ only in their number of trees or rounds, or in a
forest's depth, share trees: the smaller is a part of the larger. What a forest draws is named by seed,
tree and node, so nothing depends on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.session import shared_folder

HELD_BYTES = 600_000_000  # of a fold and of the work on it, in one task
ROW_BYTES = 115  # of work and label, beside a byte for each feature
TREES_AT_ONCE = 50  # of a forest in one task
CELLS_AT_ONCE = 1 << 21  # bins of the nodes looked at together
ROWS_AT_ONCE = 1 << 18  # that are put into bins together
PIECE_ROWS = 1 << 16  # tested rows whose sums make one row of a shuffle
SAME = 1e-12  # gain, as a share of a node's squares, that is only rounding

# Parameters that are followed, and those that say how MLlib goes about it.
FOLLOWED = {"labelCol", "maxBins", "maxDepth", "minInstancesPerNode", "numTrees", "maxIter", "stepSize", "seed"}
MEANS = {"cacheNodeIds", "checkpointInterval", "maxMemoryInMB"}


def fits_task(rows: int, features: int) -> bool:
    return rows * (features + ROW_BYTES) <= HELD_BYTES


def grows(reg: Estimator, params: dict, label: str) -> bool:
    """Whether the trees of a regressor are grown here; any other parameter must have MLlib's default."""
    if not isinstance(reg, (RandomForestRegressor, GBTRegressor)):
        return False
    usual = {p.name: v for p, v in type(reg)().extractParamMap().items()}
    found = {p.name: v for p, v in reg.extractParamMap(params).items()}
    other = all(name in usual and v == usual[name] for name, v in found.items() if name not in FOLLOWED | MEANS)
    return other and found["maxBins"] <= 256 and found["labelCol"] == label


# ------------------------------------------------------------------ rows of a fold


@dataclass
class Rows:
    bins: np.ndarray  # one row per row, a byte per feature
    y: np.ndarray

    def ordered(self) -> Rows:
        """In an order that only the values decide."""
        order = np.lexsort((self.y, *self.bins.T))
        return Rows(np.ascontiguousarray(self.bins[order]), self.y[order])


def write_rows(rows: DataFrame, features: int, label: str) -> str:
    """A column per feature, so that a task reads one at a time."""
    folder = shared_folder(rows.sparkSession, "fold")
    values = rows.select(vector_to_array("features").alias("v"), F.col(label).cast("double").alias("y"))
    values.select(*[F.col("v")[k].alias(f"f{k}") for k in range(features)], "y").write.parquet(folder)
    return folder


def _column(folder: str, name: str) -> np.ndarray:
    store, path = fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
    found = [np.empty(0)]
    for file in files:
        with store.open_input_file(file) as source:
            found.append(pq.ParquetFile(source).read(columns=[name]).column(0).to_numpy())
    return np.concatenate(found)


def thresholds(values: np.ndarray, most_bins: int) -> np.ndarray:
    """MLlib's candidate thresholds of a feature, from all its values."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    splits = min(most_bins, len(values)) - 1
    if len(middle) <= splits:
        return middle
    upto = np.cumsum(counts)
    stride = len(values) / (splits + 1)
    cuts, target, at = [], stride, 1
    while at < len(upto):
        at = max(at, int(np.searchsorted(upto, target, side="right")))
        if at < len(upto) and not abs(upto[at - 1] - target) < abs(upto[at] - target):
            at += 1
        if at < len(upto):
            cuts.append(at - 1)
        target += stride
        at += 1
    return middle[cuts]


def binned(features: int, train: Callable[[int], np.ndarray], test: Callable[[int], np.ndarray], y: np.ndarray, y_test: np.ndarray, most_bins: int):
    """Both sets of rows by the bins of the first; features are asked for one by one."""
    bins, tested = np.empty((len(y), features), np.uint8), np.empty((len(y_test), features), np.uint8)
    for k in range(features):
        values = train(k)
        cuts = thresholds(values, most_bins)
        bins[:, k] = np.searchsorted(cuts, values)
        tested[:, k] = np.searchsorted(cuts, test(k))
    return Rows(bins, y).ordered(), Rows(tested, y_test).ordered()


_kept: dict[tuple, tuple[Rows, Rows]] = {}


def _read(family: Family) -> tuple[Rows, Rows]:
    """The rows of a fold; a worker keeps those it read last."""
    key = (family.train, family.test, family.most_bins)
    if key not in _kept:
        _kept.clear()
        column = lambda folder: lambda k: _column(folder, f"f{k}")
        y, y_test = _column(family.train, "y"), _column(family.test, "y")
        _kept[key] = binned(family.features, column(family.train), column(family.test), y, y_test, family.most_bins)
    return _kept[key]


# ------------------------------------------------------------------ one tree


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finish of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _features(nodes: np.ndarray, key: np.uint64, features: int, chosen: int) -> np.ndarray:
    """The features each node looks at, in ascending order: one row per node."""
    if chosen == features:
        return np.broadcast_to(np.arange(features), (len(nodes), features))
    draws = _mixed(_mixed(nodes + key)[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(draws, chosen - 1, axis=1)[:, :chosen], axis=1)


def _best_splits(rows: Rows, most_bins: int, at, node, weight, off, of, total, least: int):
    """(gain, feature, last bin to the left) of each node; ``off`` is a row's weighted distance from its node's mean."""
    m, features, chosen = len(total), rows.bins.shape[1], of.shape[1]
    flat, first, base = rows.bins.reshape(-1), at * features, node * most_bins
    best, feature, cut, every = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    for k in range(chosen):
        n = s = None
        for low in range(0, len(at), ROWS_AT_ONCE):
            part = slice(low, low + ROWS_AT_ONCE)
            code = flat[first[part] + (k if chosen == features else of[node[part], k])] + base[part]
            found = (np.bincount(code, x, m * most_bins) for x in (None if weight is None else weight[part], off[part]))
            n, s = found if n is None else (x + y for x, y in zip((n, s), found, strict=True))
        n, s = (x.reshape(m, -1).cumsum(axis=1)[:, :-1] for x in (n, s))
        rest = total[:, None] - n
        # sums to the left and right cancel out, so the gain of a split is s * s * total / (n * rest)
        gain = np.where((n >= least) & (rest >= least), s * s / np.maximum(n * rest, 1), 0.0)
        place = gain.argmax(axis=1)
        gain = gain[every, place] * total
        better = gain > best
        best[better], feature[better], cut[better] = gain[better], of[better, k], place[better]
    return best, feature, cut


def grow(
    train: Rows, target: np.ndarray, weight: np.ndarray | None, test: Rows, depths: Sequence[int], least: int, chosen: int, key: int, most_bins: int
) -> tuple[np.ndarray, np.ndarray]:
    """One tree: the values of the rows fitted, and of the tested rows if it ended at each of ``depths``.

    Nodes of a level are looked at together, as many as ``CELLS_AT_ONCE`` allows; the others wait.
    """
    depths = np.asarray(depths)
    fitted, tested = np.zeros(len(target)), np.zeros((len(depths), len(test.y)))
    held = np.arange(len(target)) if weight is None else np.flatnonzero(weight)
    start = np.zeros(len(held), np.int64), np.arange(len(test.y)), np.zeros(len(test.y), np.int64)
    waiting = [(0, np.array([1], np.uint64), held, *start)]
    most_nodes = max(1, CELLS_AT_ONCE // most_bins)
    while waiting:
        level, ids, at, node, at_test, node_test = waiting.pop()
        if len(ids) > most_nodes:
            for low in range(0, len(ids), most_nodes):
                part, tests = ((x >= low) & (x < low + most_nodes) for x in (node, node_test))
                waiting.append((level, ids[low : low + most_nodes], at[part], node[part] - low, at_test[tests], node_test[tests] - low))
            continue
        w = None if weight is None else weight[at]
        t = target[at]
        total = np.bincount(node, w, len(ids))
        mean = np.bincount(node, t if w is None else w * t, len(ids)) / total
        fitted[at] = mean[node]
        tested[np.ix_(depths >= level, at_test)] = mean[node_test]
        if level == depths.max():
            continue
        off = t - mean[node]
        squares = np.bincount(node, off * off if w is None else w * off * off, len(ids))
        if w is not None:
            off *= w
        open_ = (total >= 2 * least) & (squares > 0)
        if not open_.all():  # before the bins are counted: most nodes far down are small
            some, inner, tests = np.cumsum(open_) - 1, open_[node], open_[node_test]
            ids, total, squares = ids[open_], total[open_], squares[open_]
            at, off, w, node = at[inner], off[inner], None if w is None else w[inner], some[node[inner]]
            at_test, node_test = at_test[tests], some[node_test[tests]]
        if not len(ids):
            continue
        of = _features(ids, np.uint64(key), train.bins.shape[1], chosen)
        gain, feature, cut = _best_splits(train, most_bins, at, node, w, off, of, total, least)
        split = gain > SAME * squares
        child = 2 * (np.cumsum(split) - 1)
        inner, tests = split[node], split[node_test]
        at, node, at_test, node_test = at[inner], node[inner], at_test[tests], node_test[tests]
        if len(at):
            down = child[node] + (train.bins[at, feature[node]] > cut[node])
            down_test = child[node_test] + (test.bins[at_test, feature[node_test]] > cut[node_test])
            ids = (2 * ids[split][:, None] + np.arange(2, dtype=np.uint64)).reshape(-1)
            waiting.append((level + 1, ids, at, down, at_test, down_test))
    return fitted, tested


def forest_sums(train: Rows, test: Rows, trees: range, depths: Sequence[int], least: int, chosen: int, seed: int, most_bins: int) -> np.ndarray:
    """Sums of the tested rows' values over some trees, for each depth; a tree draws its rows with replacement."""
    out = np.zeros((len(depths), len(test.y)))
    for k in trees:
        draws = np.random.Generator(np.random.PCG64([seed % (1 << 64), k]))
        key = int(draws.integers(1 << 63))
        weight = draws.poisson(1.0, len(train.y)).astype(np.float64)
        if weight.any():
            out += grow(train, train.y, weight, test, depths, least, chosen, key, most_bins)[1]
    return out


def boosted_values(train: Rows, test: Rows, rounds: Sequence[int], step: float, depth: int, least: int, most_bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """Values of the tested rows after each of ``rounds``: the first tree fits the label, each other twice what is left."""
    reached, out = np.zeros(len(train.y)), np.zeros(len(test.y))
    for k in range(1, max(rounds) + 1):
        target = train.y if k == 1 else 2 * (train.y - reached)
        fitted, tested = grow(train, target, None, test, [depth], least, train.bins.shape[1], 0, most_bins)
        share = 1.0 if k == 1 else step
        reached += share * fitted
        out += share * tested[0]
        if k in rounds:
            yield k, out


# ------------------------------------------------------------------ all candidates


@dataclass
class Fold:
    """Rows fitted and tested in the shared folder, and the parameters of every candidate under them."""

    train: str
    test: str
    rows: int
    features: int
    candidates: list[tuple[Estimator, dict]]


@dataclass
class Family:
    """Candidates of a fold that share their trees, by (depth, trees) or by rounds."""

    fold: int
    train: str
    test: str
    features: int
    forest: bool
    most_bins: int
    least: int
    seed: int
    chosen: int
    step: float
    depths: list[int]
    counts: list[int]
    members: dict[tuple[int, int], list[int]]


def _families(number: int, fold: Fold) -> list[Family]:
    out: dict[tuple, Family] = {}
    for place, (reg, params) in enumerate(fold.candidates):
        found = {p.name: v for p, v in reg.extractParamMap(params).items()}
        forest, depth = isinstance(reg, RandomForestRegressor), found["maxDepth"]
        count = found["numTrees" if forest else "maxIter"]
        # MLlib's choice "auto": a third of the features, all of them for a single tree
        chosen = -(-fold.features // 3) if forest and count > 1 else fold.features
        same = (forest, found["maxBins"], found["minInstancesPerNode"], found["seed"] if forest else 0, chosen, 0.0 if forest else found["stepSize"])
        family = out.setdefault((*same, None if forest else depth), Family(number, fold.train, fold.test, fold.features, *same, [], [], {}))
        family.members.setdefault((depth, count), []).append(place)
        family.depths, family.counts = sorted({*family.depths, depth}), sorted({*family.counts, count})
    return list(out.values())


def _blocks(family: Family) -> list[range]:
    """A forest's trees in parts of even size that end where a candidate does."""
    out = []
    for low, high in zip([0, *family.counts], family.counts, strict=False):
        parts = -(-(high - low) // TREES_AT_ONCE)
        edges = [low + (high - low) * k // parts for k in range(parts + 1)]
        out += [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return out


ERRORS = "fold int, candidate int, piece int, n long, absolute double, squared double"
_ERRORS = pa.schema([("fold", pa.int32()), ("candidate", pa.int32()), ("piece", pa.int32()), ("n", pa.int64()), ("absolute", pa.float64()), ("squared", pa.float64())])
SUMS = "fold int, family int, piece int, start int, upto int, sums binary, y binary"
_SUMS = pa.schema(
    [("fold", pa.int32()), ("family", pa.int32()), ("piece", pa.int32()), ("start", pa.int32()), ("upto", pa.int32()), ("sums", pa.binary()), ("y", pa.binary())]
)


def _error_rows(family: Family, member: tuple[int, int], piece: int, y: np.ndarray, values: np.ndarray) -> list[dict]:
    off = np.abs(y - values)
    found = {"fold": family.fold, "piece": piece, "n": len(y), "absolute": float(off.sum()), "squared": float((off * off).sum())}
    return [{**found, "candidate": c} for c in family.members[member]]


def _forest_errors(spark: SparkSession, families: list[Family]) -> DataFrame:
    units = [(k, block) for k, family in enumerate(families) for block in _blocks(family)]
    def sums(batches):
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                number, block = units[unit]
                family = families[number]
                train, test = _read(family)
                out = forest_sums(train, test, block, family.depths, family.least, family.chosen, family.seed, family.most_bins)
                for piece, low in enumerate(range(0, len(test.y), PIECE_ROWS)):
                    part = slice(low, low + PIECE_ROWS)
                    y = test.y[part].tobytes() if block.start == 0 else None
                    row = dict(zip(_SUMS.names, (family.fold, number, piece, block.start, block.stop, out[:, part].tobytes(), y), strict=True))
                    yield pa.RecordBatch.from_pylist([row], _SUMS)

    def errors(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        family, y = families[rows[0]["family"]], np.frombuffer(rows[0]["y"])
        total, out = np.zeros((len(family.depths), len(y))), []
        for r in rows:
            total += np.frombuffer(r["sums"]).reshape(total.shape)
            for k, depth in enumerate(family.depths):
                if (depth, r["upto"]) in family.members:
                    out += _error_rows(family, (depth, r["upto"]), r["piece"], y, total[k] / r["upto"])
        return pa.Table.from_pylist(out, _ERRORS)

    return spark.range(0, len(units), 1, len(units)).mapInArrow(sums, SUMS).groupBy("fold", "family", "piece").applyInArrow(errors, ERRORS)


def _boosted_errors(spark: SparkSession, families: list[Family]) -> DataFrame:
    def errors(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                family = families[number]
                train, test = _read(family)
                depth, out = family.depths[0], []
                for count, values in boosted_values(train, test, family.counts, family.step, depth, family.least, family.most_bins):
                    out += _error_rows(family, (depth, count), 0, test.y, values)
                yield pa.RecordBatch.from_pylist(out, _ERRORS)

    return spark.range(0, len(families), 1, len(families)).mapInArrow(errors, ERRORS)


def tree_errors(spark: SparkSession, folds: list[Fold]) -> list[list[tuple[float | None, float | None]]]:
    """(MAE, RMSE) of every candidate in every fold, all grown in one job; the largest folds go first."""
    families = [f for k in sorted(range(len(folds)), key=lambda k: -folds[k].rows) for f in _families(k, folds[k])]
    kinds = [(_boosted_errors, [f for f in families if not f.forest]), (_forest_errors, [f for f in families if f.forest])]
    found: dict[tuple[int, int], list] = {}
    frames = [job(spark, some) for job, some in kinds if some]
    rows = []
    if frames:
        every = frames[0]
        for frame in frames[1:]:
            every = every.unionByName(frame)
        rows = every.collect()  # a few numbers per candidate, fold and 65,536 tested rows
    for r in sorted(rows, key=lambda r: r["piece"]):
        found.setdefault((r["fold"], r["candidate"]), []).append(r)

    def error(of):
        n = sum(r["n"] for r in of)
        return (sum(r["absolute"] for r in of) / n, (sum(r["squared"] for r in of) / n) ** 0.5) if n else (None, None)

    return [[error(found.get((k, c), [])) for c in range(len(fold.candidates))] for k, fold in enumerate(folds)]
