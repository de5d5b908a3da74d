"""Window operators over rows ordered by time.

``windowed`` evaluates any frame of bounded reach. Where a key is too large for
one task its rows are numbered, cut into blocks, and each block borrows the
few neighbouring rows its frames look at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leaguelens.operators.common import (
    CHUNK,
    GROUP_ROWS,
    Order,
    as_list,
    attach,
    fits_one_task,
    number_rows,
    range_chunks,
    running_total,
    window,
)
from leaguelens.operators.ordering import best_row


def windowed(
    df: DataFrame,
    keys: Order,
    order: Order,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    max_group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Add window ``columns`` that look at most ``before`` rows back and ``after`` ahead."""
    keys = as_list(keys)
    if fits_one_task(df, keys, max_group_rows):
        return df.withColumns(columns(window(keys, order)))
    size = max(max_group_rows, before + after, 1)
    numbered = number_rows(df, keys, order, "__pos", max_group_rows=0)
    pos = F.col("__pos") - 1
    home = F.floor(pos / size)
    offset = pos - home * size
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when(offset < after, home - 1),
        )
    )
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(targets))
    local = Window.partitionBy(*keys, "__block").orderBy("__pos")
    return (
        spread.withColumns(columns(local))
        .filter(F.col("__block") == F.col("__home"))
        .drop("__pos", "__home", "__block")
    )


def lag_lead(df, keys, order, col, n=1, max_group_rows=GROUP_ROWS) -> DataFrame:
    """Previous and next value, ``n`` rows away."""
    return windowed(
        df,
        keys,
        order,
        lambda w: {f"prev_{col}": F.lag(col, n).over(w), f"next_{col}": F.lead(col, n).over(w)},
        before=n,
        after=n,
        max_group_rows=max_group_rows,
    )


def trailing_mean(df, keys, order, col, n, name=None, max_group_rows=GROUP_ROWS) -> DataFrame:
    """Mean of the ``n`` rows before the current one."""
    name = name or f"{col}_last_{n}_avg"
    return windowed(
        df,
        keys,
        order,
        lambda w: {name: F.avg(col).over(w.rowsBetween(-n, -1))},
        before=n,
        max_group_rows=max_group_rows,
    )


def trailing_mean_lagged(df, keys, order, col, n, name=None, max_group_rows=GROUP_ROWS):
    """Mean of the lagged column over the current and ``n - 1`` earlier rows."""
    name = name or f"{col}_last_{n}_avg"
    lagged = windowed(
        df,
        keys,
        order,
        lambda w: {"__prev": F.lag(col).over(w)},
        before=1,
        max_group_rows=max_group_rows,
    )
    return windowed(
        lagged,
        keys,
        order,
        lambda w: {name: F.avg("__prev").over(w.rowsBetween(-(n - 1), 0))},
        before=n - 1,
        max_group_rows=max_group_rows,
    ).drop("__prev")


def trailing_count_guard(df, keys, order, col, n, max_group_rows=GROUP_ROWS) -> DataFrame:
    """Keep rows whose ``n`` preceding rows all have a value."""
    count = "__seen"
    counted = windowed(
        df,
        keys,
        order,
        lambda w: {count: F.count(col).over(w.rowsBetween(-n, -1))},
        before=n,
        max_group_rows=max_group_rows,
    )
    return counted.filter(F.col(count) == n).drop(count)


def trailing_std(df, keys, order, col, n=5, min_n=2, name=None, max_group_rows=GROUP_ROWS):
    """Sample deviation of the ``n`` rows before; NULL under ``min_n`` values."""
    name = name or f"{col}_last_{n}_std"

    def cols(w):
        frame = w.rowsBetween(-n, -1)
        enough = F.count(col).over(frame) >= min_n
        return {name: F.when(enough, F.stddev_samp(col).over(frame))}

    return windowed(df, keys, order, cols, before=n, max_group_rows=max_group_rows)


def season_to_date_mean(df, keys, season, order, col, name=None, max_group_rows=GROUP_ROWS):
    """Mean of the earlier rows of the same season."""
    name = name or f"{col}_season_avg"
    keys = as_list(keys) + as_list(season)
    if fits_one_task(df, keys, max_group_rows):
        frame = window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.avg(col).over(frame))
    value, one = F.coalesce(F.col(col).cast("double"), F.lit(0.0)), F.col(col).isNotNull().cast("long")
    out = running_total(df, keys, order, value, "__sum", max_group_rows=0, inclusive=False)
    out = running_total(out, keys, order, one, "__n", max_group_rows=0, inclusive=False)
    return out.withColumn(name, F.try_divide("__sum", "__n")).drop("__sum", "__n")


def forward_fill(df, keys, order, col, default=None, name=None, max_group_rows=GROUP_ROWS):
    """Last known value up to the current row, else ``default``."""
    name, keys = name or f"{col}_filled", as_list(keys)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if fits_one_task(df, keys, max_group_rows):
        out = df.withColumn(
            name, F.last(col, ignorenulls=True).over(window(keys, order).rowsBetween(*upto))
        )
    else:
        chunks = range_chunks(df, keys, order)
        inner = window(keys + [CHUNK], order).rowsBetween(*upto)
        filled = chunks.withColumn(name, F.last(col, ignorenulls=True).over(inner))
        known = best_row(
            chunks.filter(F.col(col).isNotNull()), keys + [CHUNK], order, last=True
        ).select(*keys, CHUNK, F.col(col).alias("__tail"))
        every = attach(chunks.select(*keys, CHUNK).distinct(), known, keys + [CHUNK])
        earlier = window(keys, CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(
            *keys, CHUNK, F.last("__tail", ignorenulls=True).over(earlier).alias("__carry")
        )
        out = attach(filled, carried, keys + [CHUNK]).withColumn(
            name, F.coalesce(name, "__carry")
        )
        out = out.drop(CHUNK, "__carry")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def latest_per_key(df, keys, order) -> DataFrame:
    """The row of each key with the highest ``order``; a partial aggregate, no window."""
    return best_row(df, keys, [f"-{o}" for o in as_list(order)])


def dense_rank_desc(df, group, col, name=None, max_group_rows=GROUP_ROWS) -> DataFrame:
    """Dense rank from the highest value down; NULL stays NULL.

    Distinct values are numbered, so duplicates are combined before any shuffle.
    """
    name, group = name or f"{col}_rank", as_list(group)
    values = df.filter(F.col(col).isNotNull()).select(*group, col).distinct()
    ranked = number_rows(values, group, f"-{col}", name, max_group_rows)
    return attach(df, ranked, group + [col])


def group_stats(df, group, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of the row's group on every row.

    Aggregate and join back: the partial aggregate shrinks a hot group before
    the shuffle, and the join side is one row per group, which Spark
    broadcasts when small and splits by skew when not.
    """
    stats = df.groupBy(*as_list(group)).agg(*[c.alias(n) for n, c in aggs.items()])
    return attach(df, stats, group)


def rest_of_group_sum(df, group, col, name=None) -> DataFrame:
    """Sum over the other rows of the group."""
    name = name or f"{col}_rest"
    out = group_stats(df, group, {"__sum": F.sum(col)})
    return out.withColumn(name, F.col("__sum") - F.col(col)).drop("__sum")


def vs_partner(df, group, col, name=None) -> DataFrame:
    """Own value minus the partner's, in groups with exactly two values."""
    name = name or f"{col}_vs_partner"
    out = group_stats(df, group, {"__sum": F.sum(col), "__n": F.count(col)})
    gap = F.col(col) - (F.col("__sum") - F.col(col))
    return out.withColumn(name, F.when(F.col("__n") == 2, gap)).drop("__sum", "__n")


def group_max(df, group, col, name=None) -> DataFrame:
    """The group's maximum on every row."""
    return group_stats(df, group, {name or f"{col}_max": F.max(col)})


def change_and_pct(df, keys, order, col, max_group_rows=GROUP_ROWS) -> DataFrame:
    """Change since the previous row, absolute and relative (NULL over zero)."""

    def cols(w):
        prev = F.lag(col).over(w)
        gap = F.col(col) - prev
        return {f"{col}_change": gap, f"{col}_change_pct": F.try_divide(gap, prev)}

    return windowed(df, keys, order, cols, before=1, max_group_rows=max_group_rows)
