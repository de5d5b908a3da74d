"""Bootstrapped outcomes whose draws stay inside a row.

The residuals of a bucket are one sorted array (``pools``). A score's draws are indexes into it, made,
sorted and read inside the task that holds the score: no draw is a row and none is shuffled.
A selection's points per simulation are sums of such arrays, first over the members that a
task holds, then over the few partial sums. The same draws as ``outcomes.bootstrap_outcomes``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leaguelens.operators.aggregates import QUANTILES, quantile_name
from leaguelens.operators.common import Order, as_list, spread
from leaguelens.plans.outcomes import BROADCAST_ROWS, OUTCOME_KEYS, with_risk
from leaguelens.plans.pools import PRIME, Draws, FiledPools, SentPools, blocks, draw_key, file_pools, rows_at_once

DRAWS_AT_ONCE = 1 << 16  # arrays of half a megabyte, which a core keeps close
SHARES = 16  # tasks that a profile's members are dealt to
STATS = ["n", "mean", "std", *[quantile_name(q) for q in QUANTILES]]


def _pools(scores: DataFrame, residual_rows: DataFrame) -> SentPools | FiledPools:
    """Sorted residuals per bucket: sent if they are few, else in files that the tasks read."""
    bucket = "prediction_bucket"
    sizes = dict(residual_rows.groupBy(bucket).count().collect())  # one entry per band
    unknown = scores.select(bucket).distinct().where(~F.col(bucket).isin(list(sizes)) | F.col(bucket).isNull()).limit(10).collect()
    if unknown:
        raise KeyError(f"no residuals for {[r[0] for r in unknown]}")
    if sum(sizes.values()) > BROADCAST_ROWS:
        return file_pools(residual_rows, sizes)
    rows = residual_rows.select(bucket, F.col("residual").cast("double")).toPandas()
    pools = {name: np.sort(part.to_numpy(np.float64)) for name, part in rows.groupby(bucket)["residual"]}
    return SentPools(scores.sparkSession.sparkContext.broadcast(pools))


def _quantiles(ordered: np.ndarray) -> list[np.ndarray]:
    """Interpolated quantiles of rows in ascending order."""
    out, last = [], ordered.shape[1] - 1
    for q in QUANTILES:
        place = q * last
        low = int(np.floor(place))
        high = min(low + 1, last)
        out.append(ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (place - low))
    return out


def _stats(values: np.ndarray) -> list[np.ndarray]:
    n = values.shape[1]
    std = values.std(axis=1, ddof=1) if n > 1 else np.full(len(values), np.nan)
    return [np.full(len(values), n), values.mean(axis=1), std]


def outcome_summaries(
    scores: DataFrame, residual_rows: DataFrame, n_sims: int = 10_000, seed: int = 42, keys: Sequence[str] = OUTCOME_KEYS
) -> DataFrame:
    """G13 and G14 in one: the distribution of ``n_sims`` outcomes of every score.

    One row per (period, entity) is expected, as ``summarize_outcomes`` returns.
    """
    scores = scores.filter(F.col("predicted_points").isNotNull())
    pools = _pools(scores, residual_rows)
    step = rows_at_once(pools, n_sims, DRAWS_AT_ONCE)

    def run(batches):
        draws = Draws(n_sims, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__key").to_numpy()
            start = batch.column("predicted_points").cast(pa.float64()).to_numpy()
            out = np.zeros((len(STATS), batch.num_rows))
            for rows, name, index in blocks(key, batch.column("prediction_bucket").to_pylist(), pools, draws, step):
                if pools.size(name) <= PRIME:
                    index = index.astype(np.int32)  # sorts faster
                index.sort(axis=1)  # the pool is sorted, so are the values
                values = pools.values(name, index.astype(np.int64))
                found = _stats(values) + _quantiles(values)
                for k, v in enumerate(found):
                    out[k, rows] = v if k in (0, 2) else v + start[rows]
            columns = [pa.array(out[0].astype(np.int64))] + [pa.array(v, from_pandas=True) for v in out[1:]]
            kept = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays(kept + columns, names=[*keys, *STATS])

    rows = spread(scores, list(keys)[:2]).select(*keys, draw_key().alias("__key"))
    schema = T.StructType([*[scores.schema[c] for c in keys], T.StructField("n", T.LongType())])
    schema = T.StructType([*schema, *[T.StructField(c, T.DoubleType()) for c in STATS[1:]]])
    named = {"mean": "mean_simulated_points", "std": "std_simulated_points"}
    return with_risk(rows.mapInArrow(run, schema).withColumnsRenamed(named))


def selection_summaries(
    scores: DataFrame,
    residual_rows: DataFrame,
    selection: DataFrame,
    profile: Order = ("profile", "period_id"),
    n_sims: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """The distribution of each selection's points over ``n_sims`` simulations.

    Members are dealt to up to ``SHARES`` tasks per profile, so a profile of any size is
    added up in parts; a part is one array of ``n_sims`` sums.
    """
    profile = as_list(profile)
    scores = scores.filter(F.col("predicted_points").isNotNull())
    pools = _pools(scores, residual_rows)
    step = rows_at_once(pools, n_sims, DRAWS_AT_ONCE)
    on = [c for c in selection.columns if c in scores.columns]
    members = scores.join(selection.select(*{*profile, *on}).distinct(), on)
    names = [f"__p{k}" for k in range(len(profile))]

    def partial(batches):
        """Sums of the rows of each profile, which come sorted by it."""
        draws, current, total, seen = Draws(n_sims, seed), None, None, 0
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            key = batch.column("__key").to_numpy()
            start = batch.column("predicted_points").cast(pa.float64()).to_numpy()
            bucket = batch.column("prediction_bucket").to_pylist()
            for at in range(0, len(groups), step):
                end = min(at + step, len(groups))
                values = np.empty((end - at, n_sims))
                for rows, name, index in blocks(key[at:end], bucket[at:end], pools, draws, step):
                    values[rows] = pools.values(name, index)
                cuts = [at, *[k for k in range(at + 1, end) if groups[k] != groups[k - 1]], end]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if groups[low] != current:
                        if seen:
                            yield _row(current, total)
                        current, total, seen = groups[low], np.zeros(n_sims), 0
                    total += values[low - at : high - at].sum(axis=0)
                    total += start[low:high].sum()
                    seen += high - low
        if seen:
            yield _row(current, total)

    kinds = [members.schema[c].dataType for c in profile]
    arrow = [to_arrow_type(kind) for kind in kinds]

    def _row(group, total):
        arrays = [pa.array([g], kind) for g, kind in zip(group, arrow, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([total.tobytes()], pa.binary())], names=[*names, "sums"])

    def whole(table: pa.Table) -> pa.Table:
        total = np.zeros(n_sims)
        for held in table.column("sums").to_pylist():
            total += np.frombuffer(held, np.float64)
        values = np.sort(total)[None, :]
        found = _stats(values) + _quantiles(values)
        columns = [table.column(c).slice(0, 1).combine_chunks() for c in names]
        columns += [pa.array(found[0].astype(np.int64))] + [pa.array(v, from_pandas=True) for v in found[1:]]
        return pa.Table.from_arrays(columns, names=[*names, *STATS])

    fields = [T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True)]
    rows = members.select(
        *[F.col(c).alias(n) for c, n in zip(profile, names, strict=True)], draw_key().alias("__key"), "predicted_points", "prediction_bucket"
    )
    dealt = spread(rows.withColumn("__share", F.pmod(F.xxhash64("__key"), F.lit(SHARES))), [*names, "__share"])
    sums = dealt.sortWithinPartitions(*names).drop("__share").mapInArrow(partial, T.StructType([*fields, T.StructField("sums", T.BinaryType())]))
    stats = [T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in STATS[1:]]]
    out = sums.groupBy(*names).applyInArrow(whole, T.StructType([*fields, *stats]))
    renamed = dict(zip(names, profile, strict=True)) | {"mean": "mean_selection_points", "std": "std_selection_points"}
    return out.withColumnsRenamed(renamed)
