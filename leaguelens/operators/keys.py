"""Dimension and surrogate-key operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.aggregates import max_or
from leaguelens.operators.common import Order, as_list, attach, number_rows
from leaguelens.operators.ordering import one_per_key


def assign_keys(df: DataFrame, natural_key: Order, order: Order, id_col: str) -> DataFrame:
    """Ids 1..N over the distinct natural keys in sort order."""
    return number_rows(one_per_key(df, natural_key), [], order, id_col)


def extend_keys(new: DataFrame, dim: DataFrame, key: Order, order: Order, id_col: str) -> DataFrame:
    """The dimension plus unseen members, numbered on from its highest id."""
    key = as_list(key)
    unseen = one_per_key(new, key).join(dim, key, "left_anti")
    last = max_or(dim, id_col, 0, "__last").select("__last").scalar()
    added = number_rows(unseen, [], order, id_col).withColumn(id_col, F.col(id_col) + last)
    return dim.unionByName(added, allowMissingColumns=True)


def number_within_season(
    df: DataFrame, season: str, order: Order, name: str = "period_num", existing=None
) -> DataFrame:
    """D3: number the periods of each season, going on from those already numbered."""
    out = number_rows(df, season, order, name)
    if existing is None:
        return out
    last = existing.groupBy(season).agg(F.max(name).alias("__last"))
    return attach(out, last, season).withColumn(
        name, F.col(name) + F.coalesce("__last", F.lit(0))
    ).drop("__last")


def flag_members(df: DataFrame, key: Order, members: DataFrame, name: str) -> DataFrame:
    """Whether the key is in the member set."""
    hit = members.select(*as_list(key)).distinct().withColumn(name, F.lit(True))
    return df.join(hit, as_list(key), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def next_run_id(log: DataFrame, col: str) -> DataFrame:
    """Highest id plus one."""
    return max_or(log, col, 0, "__m").select((F.col("__m") + 1).alias(f"next_{col}"))


def stability_check(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Ids with several names and names with several ids."""
    pairs = df.select(F.col(id_col).cast("string").alias("i"), F.col(name_col).cast("string").alias("n"))
    sides = []
    for side, own, other in ((id_col, "i", "n"), (name_col, "n", "i")):
        bad = pairs.groupBy(own).agg(F.count_distinct(other).alias("n_distinct"))
        sides.append(
            bad.filter("n_distinct > 1").select(
                F.lit(side).alias("side"), F.col(own).alias("value"), "n_distinct"
            )
        )
    return reduce(DataFrame.unionByName, sides)


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: Order, mapping: dict[str, str]):
    """Non-NULL override values (``{base: override}``) replace base values."""
    keys = as_list(keys)
    present = {b: o for b, o in mapping.items() if b in df.columns and o in overrides.columns}
    out = df.join(overrides.select(*keys, *present.values()), keys, "left")
    new = {b: F.coalesce(F.col(o).cast(df.schema[b].dataType), F.col(b)) for b, o in present.items()}
    return out.withColumns(new).drop(*present.values())
