"""Residuals to draw from, and the draws, inside a task.

Few residuals are sent with the code. More are sorted by Spark into files of the shared
folder, from which the tasks read them: 8 bytes each, kept by a worker up to ``HELD_ROWS``;
beyond, a block of draws is sorted and meets the files piece by piece. Draws are
those of ``outcomes.draw_index`` and never a row of a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import CHUNK_ROWS
from leaguelens.session import shared_folder

DRAWS_PER_READ = 1 << 22  # drawn at once where each block reads the files anew
HELD_ROWS = 32_000_000  # 256 MB a worker
PRIME = (1 << 31) - 1

_P, _BITS = np.uint64(PRIME), np.uint64(31)


def draw_key() -> Column:
    return F.pmod(F.col("entity_id") * 613 + F.col("period_id"), F.lit(PRIME)).cast("long")


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Adds the upper bits of x to its lower 31, in place: the same modulo 2^31 - 1, and smaller."""
    np.right_shift(x, _BITS, out=spare)
    np.bitwise_and(x, _P, out=x)
    np.add(x, spare, out=x)


class Draws:
    """The indexes of ``outcomes.draw_index`` for ``n_sims`` simulations.

    Only the last step needs the least remainder; before it, two folds keep products below 2^64.
    """

    def __init__(self, n_sims: int, seed: int):
        sims = np.arange(n_sims, dtype=np.int64)
        row = lambda x: x.astype(np.uint64)[None, :]
        self.n_sims = n_sims
        self.first = row((sims * 7919 + seed * 1299709) % PRIME), row(sims), 104729, 31
        self.second = row((sims * 15485863 + seed * 49979687 + 1) % PRIME), row(sims * 17), 32452843, 1
        self.spare: list[np.ndarray] = []

    def _mixed(self, stream, key: np.ndarray, x: np.ndarray, spare: np.ndarray, out: np.ndarray) -> None:
        by_sim, more, factor, times = stream
        np.add(by_sim, (key * factor % PRIME).astype(np.uint64), out=x)
        np.multiply(x, x, out=out)
        _fold(out, spare)
        _fold(out, spare)
        np.multiply(out, x, out=out)
        np.add(more, (key * times).astype(np.uint64), out=x)
        np.add(out, x, out=out)
        _fold(out, spare)
        _fold(out, spare)
        np.subtract(out, _P, out=spare)  # wraps around where nothing is to be taken off
        np.minimum(out, spare, out=out)

    def indexes(self, key: np.ndarray, size: int) -> np.ndarray:
        """One row per key, one column per simulation; overwritten by the next call."""
        key = key.astype(np.int64)[:, None]
        need = len(key) * self.n_sims
        if not self.spare or len(self.spare[0]) < need:
            self.spare = [np.empty(need, np.uint64) for _ in range(4)]
        x, spare, other, out = (buffer[:need].reshape(len(key), -1) for buffer in self.spare)
        self._mixed(self.first, key, x, spare, out)
        self._mixed(self.second, key, x, spare, other)
        np.multiply(out, _P, out=out)
        np.add(out, other, out=out)
        np.floor_divide(out, np.uint64(size), out=spare)
        np.multiply(spare, np.uint64(size), out=spare)
        np.subtract(out, spare, out=out)
        return out.view(np.int64)


class SentPools:
    """Sorted residuals by bucket, sent with the code."""

    held = True

    def __init__(self, sent):
        self.sent = sent

    def size(self, bucket) -> int:
        return len(self.sent.value[bucket])

    def values(self, bucket, index: np.ndarray) -> np.ndarray:
        return self.sent.value[bucket][index]


def _pieces(folder: str) -> Iterator[np.ndarray]:
    """The residuals of a folder in order, ``CHUNK_ROWS`` at most at once."""
    store, path = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
    for name in names:
        with store.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(CHUNK_ROWS, columns=["residual"]):
                yield batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)


@lru_cache(maxsize=1)
def _held(folder: str) -> np.ndarray:
    return np.concatenate(list(_pieces(folder)))


class FiledPools:
    """Residuals sorted by bucket and size in the files of a folder."""

    def __init__(self, folder: str, sizes: dict, held_rows: int):
        self.folder, self.sizes, self.starts, at = folder, sizes, {}, 0
        for bucket in sorted(sizes, key=lambda b: b.encode() if isinstance(b, str) else b):
            self.starts[bucket] = at
            at += sizes[bucket]
        self.held = at <= held_rows

    def size(self, bucket) -> int:
        return self.sizes[bucket]

    def values(self, bucket, index: np.ndarray) -> np.ndarray:
        place = index + self.starts[bucket]
        if self.held:
            return _held(self.folder)[place]
        flat = place.ravel()
        order = np.argsort(flat)
        ordered = flat[order]
        out, at, done = np.empty(len(flat)), 0, 0
        for piece in _pieces(self.folder):
            upto = int(np.searchsorted(ordered, at + len(piece)))
            out[order[done:upto]] = piece[ordered[done:upto] - at]
            at, done = at + len(piece), upto
        return out.reshape(index.shape)


def file_pools(residual_rows: DataFrame, sizes: dict, held_rows: int | None = None) -> FiledPools:
    """Sort the residuals into files of the shared folder; ``sizes`` are their numbers by bucket."""
    folder = shared_folder(residual_rows.sparkSession, "pool")
    rows = residual_rows.filter(F.col("prediction_bucket").isNotNull())
    known = {bucket: n for bucket, n in sizes.items() if bucket is not None}
    rows = rows.select("prediction_bucket", F.col("residual").cast("double").alias("residual"), F.xxhash64(*rows.columns).alias("__tie"))
    order = ["prediction_bucket", F.col("residual").asc_nulls_last()]
    parts = max(1, -(-sum(known.values()) // CHUNK_ROWS))
    # the tie spreads equal residuals over the partitions
    rows = rows.repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order)
    rows.select("residual").write.parquet(folder)
    return FiledPools(folder, known, HELD_ROWS if held_rows is None else held_rows)


def rows_at_once(pools, n_sims: int, draws: int) -> int:
    return max(1, (draws if pools.held else DRAWS_PER_READ) // n_sims)


def blocks(keys: np.ndarray, buckets: list, pools, draws: Draws, step: int):
    """(rows, bucket, indexes) of rows of one bucket, ``step`` at most."""
    names = np.array(buckets, object)
    for name in sorted(set(buckets)):
        rows = np.flatnonzero(names == name)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, name, draws.indexes(keys[part], pools.size(name))
