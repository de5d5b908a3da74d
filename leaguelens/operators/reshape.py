"""Projection, filter and reshape operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.scalars import clip_low as clip_col
from leaguelens.functions.scalars import map_values, matches, normalize_key
from leaguelens.operators.common import Order, as_list
from leaguelens.operators.windows import group_stats


def project(df: DataFrame, cols: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Keep the listed columns that exist, in that order, and rename."""
    renames = renames or {}
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in cols if c in df.columns])


def where(df: DataFrame, pred: str | Column, **params) -> DataFrame:
    """Filter; ``:name`` markers of a text predicate take ``params``."""
    if isinstance(pred, Column):
        return df.filter(pred)
    return df.sparkSession.sql(
        f"SELECT * FROM {{rows}} WHERE {pred}", args=params or None, rows=df
    )


def drop_nulls(df: DataFrame, subset: Order = None) -> DataFrame:
    """Drop rows with a NULL in any (listed) column."""
    return df.na.drop(subset=as_list(subset) or None)


def where_in(df: DataFrame, col: str, values: Sequence, negate: bool = False) -> DataFrame:
    """Membership in a short literal list."""
    hit = F.col(col).isin(list(values))
    return df.filter(~hit if negate else hit)


def where_in_subquery(df: DataFrame, keys: Order, sub: DataFrame) -> DataFrame:
    """P5: ``(a, b) IN (SELECT a, b ...)``."""
    return df.join(sub, as_list(keys), "left_semi")


def where_scalar(df: DataFrame, col: str, scalar_df: DataFrame) -> DataFrame:
    """Equality with a one-row query; Spark folds it into a scalar subquery filter."""
    value = scalar_df.select(scalar_df.columns[0]).scalar()
    return df.filter(F.col(col) == value)


def where_like(df: DataFrame, col: str, pattern: str, negate: bool = False) -> DataFrame:
    """Case-insensitive pattern filter; NULL text does not match."""
    hit = matches(F.col(col), pattern)
    return df.filter(~hit if negate else hit)


def unpivot_sheet(df: DataFrame, id_col: str, var: str, value: str, source: str) -> DataFrame:
    """Wide sheet to long rows, with the sheet's name."""
    cols = [c for c in df.columns if c != id_col]
    long = df.unpivot(id_col, [F.col(f"`{c}`").cast("double").alias(c) for c in cols], var, value)
    return long.withColumn("source_sheet", F.lit(source))


def tidy_header(name: str) -> str:
    try:
        return str(int(float(name.strip())))
    except ValueError:
        return "_".join(name.strip().lower().split())


def standardize_headers(df: DataFrame, first_col: str) -> DataFrame:
    """Drop empty ``Unnamed`` columns, name the first column, tidy the others.

    Numeric headers lose their decimals; text headers become snake case.
    """
    unnamed = [c for c in df.columns if c.startswith("Unnamed")]
    if unnamed:
        filled = df.agg(*[F.count(f"`{c}`").alias(c) for c in unnamed]).first()
        df = df.drop(*[c for c in unnamed if filled[c] == 0])

    return df.toDF(first_col, *[tidy_header(c) for c in df.columns[1:]])


def pivot_fill(df, rows: Order, col: str, agg: Column, values: Sequence, fill=0) -> DataFrame:
    """P10: long to wide over a known value list, absent cells filled."""
    wide = df.groupBy(*as_list(rows)).pivot(col, list(values)).agg(agg)
    return wide.na.fill(fill, subset=[str(v) for v in values])


def bucketize(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge above the value, the last label beyond; NULL stays NULL."""
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, labels, strict=False):
        out = out.when(col < edge, F.lit(name))
    return out.otherwise(F.lit(labels[len(edges)]))


def sign_flags(df: DataFrame, col: str, up: str = "increase", down: str = "decrease") -> DataFrame:
    """0/1 flags for a rise and a fall; NULL is neither."""
    c = F.col(col)
    return df.withColumns(
        {up: F.when(c > 0, 1).otherwise(0), down: F.when(c < 0, 1).otherwise(0)}
    )


def canonicalize(df: DataFrame, col: str, alias_map: dict[str, str]) -> DataFrame:
    """Trim and lower-case, then apply the alias map."""
    return df.withColumn(col, map_values(normalize_key(F.col(col)), alias_map))


def status_flags(df: DataFrame, col: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per list of status texts."""
    flag = lambda vals: F.coalesce(F.col(col).isin(list(vals)), F.lit(False)).cast("int")
    return df.withColumns({name: flag(vals) for name, vals in groups.items()})


def resolve_column(df: DataFrame, candidates: Sequence[str], name: str) -> DataFrame:
    """Rename the first candidate that exists; raise when none does."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def shrink_to_mean(df: DataFrame, col: str, group: Order, w: float = 0.8) -> DataFrame:
    """Pull each value toward the mean of its slice."""
    out = group_stats(df, group, {"__mean": F.avg(col)})
    return out.withColumn(col, w * F.col(col) + (1 - w) * F.col("__mean")).drop("__mean")


def clip_low(df: DataFrame, col: str, lo: float = 0.0) -> DataFrame:
    """Raise values below ``lo``."""
    return df.withColumn(col, clip_col(F.col(col), lo))
