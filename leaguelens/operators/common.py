"""Helpers shared by the operator modules: ordering, null-safe joins, group sizes.

An ordered window puts every row of one key into one task. That is the
cheapest plan while no key is large, and a dead job once one key holds a third
of the table. The operators therefore look at the largest group first (one
map-side-combined count) and take a range-partitioned plan beyond
``GROUP_ROWS``. Both plans return the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leaguelens.session import checkpointed

GROUP_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
CHUNK = "__chunk"
Order = str | Column | Sequence[str | Column]


def as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def ordering(order: Order) -> list[Column]:
    """Sort columns with NULLs last; a leading ``-`` means descending."""
    out = []
    for o in as_list(order):
        if isinstance(o, Column):
            out.append(o)
        elif o.startswith("-"):
            out.append(F.col(o[1:]).desc_nulls_last())
        else:
            out.append(F.col(o).asc_nulls_last())
    return out


def window(keys: Order, order: Order) -> WindowSpec:
    return Window.partitionBy(*as_list(keys)).orderBy(*ordering(order))


def largest_group(df: DataFrame, keys: Order) -> int:
    """Rows of the most frequent key; the whole row count without keys."""
    keys = as_list(keys)
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def spread(df: DataFrame, keys: Order) -> DataFrame:
    """Hash-partition by ``keys`` before costly work per group.

    The number of partitions is explicit, so that adaptive execution does not
    merge groups of few bytes but much computation into one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *as_list(keys))


def fits_one_task(df: DataFrame, keys: Order, limit: int | None) -> bool:
    """True when every group is known to fit one task.

    ``limit=None`` says that the grain of ``df`` bounds the groups already,
    for example one row per (entity, period) partitioned by entity, and a limit
    of 0 that they are too large; neither counts anything.
    """
    if limit is None or limit == 0:
        return limit is None
    return largest_group(df, keys) <= limit


def attach(df: DataFrame, right: DataFrame, keys: Order, how: str = "left") -> DataFrame:
    """Join ``right`` on ``keys``, NULL keys matching NULL keys, as GROUP BY pairs them."""
    keys = as_list(keys)
    named = {k: f"__r_{k}" for k in keys}
    right = right.withColumnsRenamed(named)
    if not keys:
        # a keyless right side is one aggregate row
        return df.withColumns({c: right.select(c).scalar() for c in right.columns})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(named[k])) for k in keys])
    return df.join(right, on, how).drop(*named.values())


def range_chunks(df: DataFrame, keys: Order, order: Order, rows: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and number the partitions in ``__chunk``.

    ``rows``, where counted, asks for chunks of about ``CHUNK_ROWS`` at most.

    Rows of one key are spread over consecutive chunks, each one partition in
    size. The result is checkpointed, so the chunk of a row stays the same
    for every reader, also after an executor is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = max(parts, -(-rows // CHUNK_ROWS))
    cols = [F.col(k).asc_nulls_last() for k in as_list(keys)] + ordering(order)
    spread = df.repartitionByRange(parts, *cols)
    return checkpointed(spread.withColumn(CHUNK, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: Order,
    order: Order,
    value: Column,
    name: str,
    max_group_rows: int | None = GROUP_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` per key; ``order`` must be total.

    The current row counts if ``inclusive``; else the sum is that of the rows before,
    never a difference, so infinities stay where they are.
    """
    keys = as_list(keys)
    upto = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if fits_one_task(df, keys, max_group_rows):
        return df.withColumn(name, F.sum(value).over(window(keys, order).rowsBetween(*upto)))
    chunks = range_chunks(df, keys, order, df.count())
    sums = chunks.groupBy(*keys, CHUNK).agg(F.sum(value).alias("__sum"))
    earlier = window(keys, CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, CHUNK, F.sum("__sum").over(earlier).alias("__before"))
    inner = window(keys + [CHUNK], order).rowsBetween(*upto)
    return (
        attach(chunks, offsets, keys + [CHUNK])
        .withColumn("__own", F.sum(value).over(inner))
        .withColumn(name, F.coalesce(F.col("__own") + F.col("__before"), "__own", "__before"))
        .drop(CHUNK, "__own", "__before")
    )


def number_rows(
    df: DataFrame,
    keys: Order,
    order: Order,
    name: str = "row_num",
    max_group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """1..n within each key (over the whole table without keys); ``order`` must be total."""
    if fits_one_task(df, keys, max_group_rows):
        return df.withColumn(name, F.row_number().over(window(keys, order)).cast("long"))
    one = F.lit(1).cast("long")
    return running_total(df, keys, order, one, name, max_group_rows=0)
