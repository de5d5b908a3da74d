"""Set operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import Order
from leaguelens.operators.ordering import best_row


def union_tagged(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL with the source's name on each row."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged)


def union_loose(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of differing columns, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def column_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns only one side has."""
    left, right = set(a.columns), set(b.columns)
    return {"missing": sorted(left - right), "extra": sorted(right - left)}


def column_diff_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns only one side has, each with its filled values: (kind, column_name, n_filled)."""
    diff = column_diff(a, b)
    parts = []
    for kind, df in (("missing", a), ("extra", b)):
        if diff[kind]:
            counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in diff[kind]])
            cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_filled")) for c in diff[kind]]
            parts.append(counts.select(F.lit(kind).alias("kind"), F.inline(F.array(*cells))))
    if not parts:
        return a.sparkSession.createDataFrame([], "kind string, column_name string, n_filled long")
    return reduce(DataFrame.unionByName, parts)


def union_priority(dfs: Sequence[DataFrame], keys: Order, order: Order = ()) -> DataFrame:
    """U4: one row per key, earlier sources first, then ``order``."""
    ranked = [df.withColumn("__src", F.lit(i)) for i, df in enumerate(dfs)]
    merged = union_loose(ranked)
    order = [order] if isinstance(order, str) else list(order)
    return best_row(merged, keys, ["__src", *order]).drop("__src")
