"""Join operators.

Nothing here hints a broadcast: Spark broadcasts a side below
``spark.sql.autoBroadcastJoinThreshold``, re-checks with real sizes at run time
(AQE) and falls back to a shuffle join, splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.scalars import normalize_key
from leaguelens.operators.common import GROUP_ROWS, Order, as_list
from leaguelens.operators.windows import forward_fill


def join_inner(left: DataFrame, right: DataFrame, on: Order) -> DataFrame:
    """Inner equi-join."""
    return left.join(right, as_list(on), "inner")


def join_left(left: DataFrame, right: DataFrame, on: Order) -> DataFrame:
    """Left equi-join on several keys."""
    return left.join(right, as_list(on), "left")


def star_join(spine: DataFrame, dims: Sequence[tuple[DataFrame, Order]]) -> DataFrame:
    """Enrich a spine with a chain of left joins."""
    for dim, on in dims:
        spine = join_left(spine, dim, on)
    return spine


def join_normalized(
    left: DataFrame,
    right: DataFrame,
    text_keys: dict[str, str],
    exact_keys: Order = (),
    how: str = "left",
) -> DataFrame:
    """Equi-join on trimmed lower-case text (``{left: right}``) and exact keys.

    The normal form becomes a key column on each side, so this stays a hash join.
    """
    exact = as_list(exact_keys)
    names = [f"__k{i}" for i in range(len(text_keys))]
    for name, (lcol, rcol) in zip(names, text_keys.items(), strict=True):
        left = left.withColumn(name, normalize_key(F.col(lcol)))
        right = right.withColumn(name, normalize_key(F.col(rcol)))
    shared = {c for c in right.columns if c in left.columns} - set(exact) - set(names)
    return left.join(right.drop(*shared), names + exact, how).drop(*names)


def join_anti(left: DataFrame, right: DataFrame, on: Order) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right, as_list(on), "left_anti")


def join_semi(left: DataFrame, right: DataFrame, on: Order) -> DataFrame:
    """Left rows with a partner."""
    return left.join(right, as_list(on), "left_semi")


def join_grain_safe(
    left: DataFrame, right: DataFrame, on: Order, aggs: dict[str, Column] | None = None
) -> DataFrame:
    """Bring the right side to one row per key first, so the join cannot fan out."""
    on = as_list(on)
    if aggs:
        unique = right.groupBy(*on).agg(*[c.alias(n) for n, c in aggs.items()])
    else:
        unique = right.select(*on).distinct()
    return left.join(unique, on, "left")


def pair_with(df: DataFrame, group: Order, id_col: str, anchors: DataFrame) -> DataFrame:
    """Every row of a group beside the group's anchor row.

    ``anchors`` has one row per group, such as its leader; the output has as
    many rows as ``df`` has in those groups. The anchor itself is left out.
    Anchor columns get the suffix ``_b``.
    """
    group = as_list(group)
    other = anchors.withColumnsRenamed({c: f"{c}_b" for c in anchors.columns if c not in group})
    return df.join(other, group).filter(F.col(id_col) != F.col(f"{id_col}_b"))


def asof_carry(
    spine: DataFrame,
    obs: DataFrame,
    keys: Order,
    at: str,
    order: str,
    cols: Order,
    default: dict[str, object] | None = None,
    strict: bool = False,
    max_group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Attach the latest observation at or before ``at`` (before it, if ``strict``).

    Both sides go on one time line per key and the observation is carried
    forward: one shuffle, and no row meets all earlier rows of its key.
    Observations are unique per (key, ``order``).
    """
    keys, cols = as_list(keys), as_list(cols)
    carried = [c for c in cols if c not in keys]
    seen = F.struct(*[F.col(c).alias(f"o_{c}") for c in carried])
    # at equal times an observation precedes the spine row unless strict
    line = spine.select(
        *[F.col(k) for k in keys],
        F.col(at).alias("__at"),
        F.lit(0 if strict else 1).alias("__side"),
        F.struct(*spine.columns).alias("__spine"),
    ).unionByName(
        obs.select(
            *[F.col(k) for k in keys],
            F.col(order).alias("__at"),
            F.lit(1 if strict else 0).alias("__side"),
            seen.alias("__obs"),
        ),
        allowMissingColumns=True,
    )
    filled = forward_fill(
        line, keys, ["__at", "__side"], "__obs", name="__seen", max_group_rows=max_group_rows
    )
    default = default or {}
    values = []
    for c in carried:
        got = F.col(f"__seen.o_{c}")
        name = c if c not in spine.columns else f"{c}_asof"
        values.append((F.coalesce(got, F.lit(default[c])) if c in default else got).alias(name))
    return filled.filter(F.col("__spine").isNotNull()).select("__spine.*", *values)


def join_one_to_one(left: DataFrame, right: DataFrame, on: Order, how: str = "inner") -> DataFrame:
    """Join that raises when a key repeats on either side."""
    on = as_list(on)
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{side} side has duplicate keys {on}")
    return left.join(right, on, how)


def lookup_first(left: DataFrame, sources: Sequence[DataFrame], on: Order, col: str) -> DataFrame:
    """Value of the first source that has one."""
    on = as_list(on)
    names = [f"__v{i}" for i in range(len(sources))]
    for name, source in zip(names, sources, strict=True):
        left = left.join(source.select(*on, F.col(col).alias(name)), on, "left")
    return left.withColumn(col, F.coalesce(*names)).drop(*names)
