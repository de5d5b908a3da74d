"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import (
    GROUP_ROWS,
    Order,
    as_list,
    attach,
    number_rows,
    running_total,
)

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def group_agg(df: DataFrame, keys: Order, aggs: dict[str, Column]) -> DataFrame:
    """A1: grouped aggregates."""
    return df.groupBy(*as_list(keys)).agg(*[c.alias(n) for n, c in aggs.items()])


def group_distinct(df: DataFrame, keys: Order, cols: Sequence[str]) -> DataFrame:
    """A2: distinct values per column."""
    return group_agg(df, keys, {f"n_{c}": F.count_distinct(c) for c in cols})


def group_having(df: DataFrame, keys: Order, aggs: dict[str, Column], pred: str | Column):
    """A3: groups whose aggregates satisfy ``pred``."""
    return group_agg(df, keys, aggs).filter(pred)


def count_if(df: DataFrame, keys: Order, preds: dict[str, Column]) -> DataFrame:
    """A4: rows per condition."""
    return group_agg(df, keys, {n: F.count_if(p) for n, p in preds.items()})


def any_true(df: DataFrame, keys: Order, col: str) -> DataFrame:
    """A5: whether any row of the group is true; NULL when all are NULL."""
    return group_agg(df, keys, {col: F.bool_or(col)})


def first_non_null(df: DataFrame, keys: Order, col: str, order: str) -> DataFrame:
    """The group's first non-NULL value in ``order``, beside the lowest ``order``."""
    known = F.when(F.col(col).isNotNull(), F.struct(order, col))
    return group_agg(df, keys, {order: F.min(order), col: F.min(known).getField(col)})


def string_agg(
    df: DataFrame, keys: Order, col: str | Column, sep=", ", name=None, part_size: int = 10_000
) -> DataFrame:
    """Distinct values of each group as sorted text; NULL where there are none.

    Duplicates are combined before the shuffle. A text lists ``part_size``
    values at most and further ones follow in the next ``part``, so a row
    stays bounded and every value is listed.
    """
    keys, c = as_list(keys), F.col(col) if isinstance(col, str) else col
    values = df.select(*keys, c.alias("__v")).distinct()
    placed = number_rows(values, keys, "__v", "__pos")
    part = F.floor((F.col("__pos") - 1) / part_size).cast("long")
    text = F.array_join(F.sort_array(F.collect_list("__v")), sep)
    out = placed.groupBy(*keys, part.alias("part")).agg(
        F.when(F.count("__v") > 0, text).alias(name or f"{col}_list")
    )
    # the NULL value sorts last: alone in a later part it says nothing
    return out.filter((F.col("part") == 0) | F.col(out.columns[-1]).isNotNull())


def collect_sorted(
    df: DataFrame, keys: Order, col: str, tie: Order = (), part_size: int = 10_000
) -> DataFrame:
    """Each group's values in order, as numbered parts of at most ``part_size``.

    One array per group would grow with the group; the parts keep every value
    and bound the row.
    """
    keys = as_list(keys)
    placed = number_rows(df.select(*keys, col, *as_list(tie)), keys, [col, *as_list(tie)], "__pos")
    part = F.floor((F.col("__pos") - 1) / part_size).cast("long")
    return (
        placed.groupBy(*keys, part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("__pos", col))).alias("__rows"))
        .withColumn(f"{col}_list", F.col(f"__rows.{col}"))
        .drop("__rows")
    )


def quantile_name(q: float) -> str:
    return "median" if q == 0.5 else f"p{round(q * 100):02d}"


def dist_summary(
    df: DataFrame,
    keys: Order,
    col: str,
    qs: Sequence[float] = QUANTILES,
    max_group_rows: int | None = GROUP_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Count, mean, sample deviation and exact (interpolated) quantiles.

    With ``max_group_rows=None`` the caller says that a group fits a task, and one
    aggregate without a sort gives all. Else distinct values are counted first, which
    combines a hot value before any shuffle, and a quantile is read where the running
    count passes its rank; too many distinct values are spread over range partitions.
    ``carry`` names columns that follow from the keys.
    """
    keys = as_list(keys)
    moments = {
        "n": F.count(col),
        f"mean_{col}": F.avg(col),
        f"std_{col}": F.stddev_samp(col),
        **{c: F.first(c) for c in carry},
    }
    names = [quantile_name(q) for q in qs]
    if max_group_rows is None:
        found = group_agg(df, keys, {**moments, "__q": F.percentile(col, F.array(*map(F.lit, qs)))})
        return found.withColumns({n: F.get("__q", F.lit(k)) for k, n in enumerate(names)}).drop("__q")
    base = group_agg(df, keys, moments)
    values = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_total(values, keys, col, F.col("__c"), "__upto", max_group_rows)
    placed = attach(upto, base.select(*keys, F.col("n").alias("__n")), keys)
    picks = {}
    for name, q in zip(names, qs, strict=True):
        rank = 1 + q * (F.col("__n") - 1)

        def at(place: Column) -> Column:
            return F.max(F.when((F.col("__upto") - F.col("__c") < place) & (place <= F.col("__upto")), F.col(col)))

        lo, hi = at(F.floor(rank)), at(F.ceil(rank))
        picks[name] = lo + (hi - lo) * F.max(rank - F.floor(rank))
    return attach(base, group_agg(placed, keys, picks), keys)


def max_or(df: DataFrame, col: str, default=0, name: str | None = None) -> DataFrame:
    """A10: global maximum, ``default`` on an empty table."""
    return df.agg(F.coalesce(F.max(col), F.lit(default)).alias(name or f"max_{col}"))


def max_strict(df: DataFrame, col: str):
    """A10: global maximum; raises on an empty table."""
    value = df.agg(F.max(col)).first()[0]
    if value is None:
        raise ValueError(f"no value of {col}")
    return value


def error_metrics(df: DataFrame, keys: Order, actual: str, pred: str) -> DataFrame:
    """MAE and RMSE over rows that have both values."""
    err = F.col(actual) - F.col(pred)
    return group_agg(
        df,
        keys,
        {"n": F.count(err), "mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err))},
    )


def share_of_total(df: DataFrame, group: Order, part: str, value: str) -> DataFrame:
    """Percentage of the group's total held by each part."""
    group = as_list(group)
    parts = df.groupBy(*group, part).agg(F.sum(value).alias(value))
    totals = parts.groupBy(*group).agg(F.sum(value).alias("__total"))
    share = F.try_divide(F.col(value) * 100, F.col("__total"))
    return attach(parts, totals, group).withColumn("pct", share).drop("__total")


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Frequency table, most frequent first."""
    return df.groupBy(col).count().orderBy(F.desc("count"), F.col(col).asc_nulls_last())


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form, from one pass over the table."""
    pairs = list(combinations(cols, 2))
    one = df.agg(
        *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in cols]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")))
    return one.select(F.inline(F.array(*cells)))
