"""Sorting, top-k and latest-row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.operators.common import Order, as_list, attach, number_rows, ordering, window


def sort(df: DataFrame, keys: Order) -> DataFrame:
    """Multi-key sort, NULLs last in both directions."""
    return df.orderBy(*ordering(keys))


def top_k(df: DataFrame, col: str, k: int, tie: Order) -> DataFrame:
    """First ``k`` rows by ``col`` (``-col`` for the largest), ties broken by ``tie``."""
    return df.orderBy(*ordering([col, *as_list(tie)])).limit(k)


def top_k_per_group(df, group, order, k: int) -> DataFrame:
    """First ``k`` rows of each group by ``order``, which must be total.

    In two steps: the first ``k`` of each (group, salt), then of each group. The salt is the
    number of the input partition, folded to the number of shuffle partitions. Every partition
    passes on at most ``k`` rows of a group, a hot group's meet in as many tasks as there are
    salts, and ``k`` rows of each salt meet at last. Neither a count nor a full sort is needed.
    """
    group = as_list(group)
    if not group:
        return df.orderBy(*ordering(order)).limit(k)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__salt", F.spark_partition_id() % salts)
    for keys in ([*group, "__salt"], group):
        first = F.row_number().over(window(keys, order))
        salted = salted.withColumn("__rn", first).filter(F.col("__rn") <= k).drop("__rn")
    return salted.drop("__salt")


def best_row(df: DataFrame, keys: Order, order: Order, last: bool = False) -> DataFrame:
    """First (or last) row of each key in ``order``, whose columns share one direction.

    ``min_by``/``max_by`` combine on the map side, so a hot key never gathers
    in one task the way ``row_number() = 1`` would make it.
    """
    keys, order = as_list(keys), as_list(order)
    down = {o.startswith("-") for o in order}
    if len(down) != 1:
        raise ValueError("order columns must all ascend or all descend")
    descending = down.pop()
    names = [o.lstrip("-") for o in order]
    # NULLs sort last whichever end is asked for
    flag = (lambda c: F.col(c).isNotNull()) if descending else (lambda c: F.col(c).isNull())
    rank = F.struct(*[x for c in names for x in (flag(c).alias(f"n_{c}"), F.col(c).alias(c))])
    pick = F.max_by if last != descending else F.min_by
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(pick(row, rank).alias("__row")).select("__row.*")


def last_n_keys(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The ``n`` keys with the latest time."""
    latest = df.groupBy(key).agg(F.max(time).alias(f"last_{time}"))
    return latest.orderBy(*ordering([f"-last_{time}", f"-{key}"])).limit(n)


def latest_before(spine: DataFrame, log: DataFrame, keys: Order, at: str, order: str) -> DataFrame:
    """T4: for each spine row the latest log row of its key with ``order`` < ``at``.

    Both sides are merged on one time line and the value is carried forward,
    so no row meets every earlier log row of its key.
    """
    from leaguelens.operators.joins import asof_carry

    cols = [c for c in log.columns if c not in as_list(keys)]
    return asof_carry(spine, log, keys, at, order, cols, strict=True)


def next_period(calendar: DataFrame, period: str, start: str, at) -> DataFrame:
    """T5: the first period that starts at or after ``at``."""
    moment = at if isinstance(at, Column) else F.lit(at)
    return calendar.filter(F.col(start) >= moment).agg(
        F.min_by(period, start).alias(period), F.min(start).alias(start)
    )


def sample_violations(df: DataFrame, n: int = 10, order: Order = ()) -> DataFrame:
    """The first ``n`` failing rows for a report, by ``order`` or else by all columns."""
    return df.orderBy(*ordering(as_list(order) or df.columns)).limit(n)


def one_per_key(df: DataFrame, keys: Order) -> DataFrame:
    """One row per key, the least by its other columns: the same on every run."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def dedupe(df: DataFrame, keys: Order, order: Order) -> DataFrame:
    """One row per key, the first in ``order``."""
    return best_row(df, keys, order)


def dense_index(df: DataFrame, group: Order, col: str, name: str) -> DataFrame:
    """Dense position of each distinct ``col`` value within its group."""
    values = df.select(*as_list(group), col).distinct()
    return attach(df, number_rows(values, group, col, name), [*as_list(group), col])
