"""Data-quality operators (V1-V11): each returns the violations as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.operators.common import Order, as_list
from leaguelens.operators.sets import column_diff

FINDING = "table_name string, check_name string, column_name string, n_bad long"


def findings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)


def _found(df: DataFrame, table: str, rows: list[tuple[str, str | None, Column]]) -> DataFrame:
    """Findings (check, column, aggregate) about a table, in one pass over it; a finding counts one row at least."""
    cells = [
        F.struct(F.lit(check).alias("check_name"), F.lit(col).cast("string").alias("column_name"), F.greatest(n, F.lit(1)).alias("n_bad"))
        for check, col, n in rows
    ]
    out = df.agg(F.array(*cells).alias("__found")).select(F.inline("__found"))
    return out.select(F.lit(table).alias("table_name"), "check_name", "column_name", F.col("n_bad").cast("long").alias("n_bad"))


def check_exists_nonempty(spark, tables: dict[str, DataFrame], expected: Sequence[str]):
    """V1: expected tables that are absent or empty."""
    out = [findings(spark, [(name, "exists", None, 1) for name in expected if name not in tables])]
    for name in expected:
        if name in tables:
            empty = tables[name].agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0")
            out.append(
                empty.select(
                    F.lit(name).alias("table_name"),
                    F.lit("not_empty").alias("check_name"),
                    F.lit(None).cast("string").alias("column_name"),
                    F.lit(1).cast("long").alias("n_bad"),
                )
            )
    return reduce(DataFrame.unionByName, out)


def check_columns(df: DataFrame, required: Sequence[str], name: str = "table") -> DataFrame:
    """V2: required columns that are absent and names with stray blanks, each with the rows it concerns."""
    rows = F.count(F.lit(1))
    bad = [("required_column", c, rows) for c in required if c not in df.columns]
    bad += [("column_whitespace", c, F.count(F.col(f"`{c}`"))) for c in df.columns if c != c.strip()]
    return _found(df, name, bad) if bad else findings(df.sparkSession, [])


def check_not_null(df: DataFrame, cols: Sequence[str], name: str = "table") -> DataFrame:
    """V3: columns with NULLs and how many, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_bad")) for c in cols]
    return (
        counts.select(F.inline(F.array(*cells)))
        .filter("n_bad > 0")
        .select(F.lit(name).alias("table_name"), F.lit("not_null").alias("check_name"), "column_name", "n_bad")
    )


def check_grain(df: DataFrame, keys: Order) -> DataFrame:
    """V4: keys that occur more than once."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def _outside(col: str, lo, hi) -> Column:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(col) < lo)
    if hi is not None:
        bad = bad | (F.col(col) > hi)
    return bad


def _unresolved(id_cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in id_cols])


def check_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """V5: rows with a value outside [lo, hi]; NULL is not judged."""
    return df.filter(_outside(col, lo, hi))


def check_coverage(df: DataFrame, group: Order, key: str, min_n: int) -> DataFrame:
    """V6: groups with fewer than ``min_n`` distinct keys."""
    counts = df.groupBy(*as_list(group)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")
    )
    return counts.filter(F.col("n_keys") < min_n)


def check_resolved(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """V7: rows with an unresolved reference."""
    return df.filter(_unresolved(id_cols))


def check_join_coverage(df: DataFrame, group: Order, col: str) -> DataFrame:
    """V7: groups in which a joined column is never filled."""
    counts = df.groupBy(*as_list(group)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(col).alias("n_filled")
    )
    return counts.filter("n_filled = 0")


def check_schema_parity(a: DataFrame, b: DataFrame, name: str = "table") -> DataFrame:
    """V8: columns only one of two frames has, each with its filled values there."""
    diff, out = column_diff(a, b), [findings(a.sparkSession, [])]
    for kind, df in (("missing", a), ("extra", b)):
        if diff[kind]:
            out.append(_found(df, name, [(f"{kind}_column", c, F.count(F.col(f"`{c}`"))) for c in diff[kind]]))
    return reduce(DataFrame.unionByName, out)


def check_leakage(df: DataFrame, cols: Sequence[str], name: str = "table") -> DataFrame:
    """V9: target-side columns that are filled in a scoring frame."""
    present = [c for c in cols if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in present])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_bad")) for c in present]
    return (
        counts.select(F.inline(F.array(*cells)))
        .filter("n_bad > 0")
        .select(F.lit(name).alias("table_name"), F.lit("leakage").alias("check_name"), "column_name", "n_bad")
    )


def _tally(df: DataFrame, table: str, rules: list[tuple[str, str | None, Column]]) -> DataFrame:
    """Findings (check, column, aggregate) whose count is above zero, in one pass over ``df``."""
    cells = [
        F.struct(F.lit(check).alias("check_name"), F.lit(col).cast("string").alias("column_name"), n.cast("long").alias("n_bad"))
        for check, col, n in rules
    ]
    out = df.agg(F.array(*cells).alias("__found")).select(F.inline("__found")).filter("n_bad > 0")
    return out.select(F.lit(table).alias("table_name"), "check_name", "column_name", "n_bad")


def _row_rules(df: DataFrame, rules: dict) -> list[tuple[str, str | None, Column]]:
    """The rules that judge single rows, each as one aggregate of the whole table."""
    rows = F.count(F.lit(1))
    out = [("not_empty", None, (rows == 0).cast("long"))]
    out += [("required_column", c, F.greatest(rows, F.lit(1))) for c in rules.get("columns", ()) if c not in df.columns]
    out += [
        ("column_whitespace", c, F.greatest(F.count(F.col(f"`{c}`")), F.lit(1))) for c in df.columns if c != c.strip()
    ]
    out += [("not_null", c, F.count_if(F.col(c).isNull())) for c in rules.get("not_null", ()) if c in df.columns]
    for col, (lo, hi) in rules.get("range", {}).items():
        out.append(("range", col, F.count_if(_outside(col, lo, hi))))
    if "resolved" in rules:
        out.append(("resolved", None, F.count_if(_unresolved(rules["resolved"]))))
    return out


def _group_rules(rules: dict) -> dict[tuple, list[tuple[str, str | None, Column, Column]]]:
    """The rules that judge groups, by group columns: (check, column, aggregate of a group, when it is bad)."""
    out: dict[tuple, list] = {}
    if "grain" in rules:
        n = F.count(F.lit(1))
        out.setdefault(tuple(as_list(rules["grain"])), []).append(("grain", None, n, F.col("__grain") > 1))
    if "coverage" in rules:
        group, key, least = rules["coverage"]
        out.setdefault(tuple(as_list(group)), []).append(
            ("coverage", None, F.count_distinct(key), F.col("__coverage") < least)
        )
    if "filled" in rules:
        group, col = rules["filled"]
        out.setdefault(tuple(as_list(group)), []).append(("filled", col, F.count(col), F.col("__filled") == 0))
    return out


def run_suite(tables: dict[str, DataFrame], spec: dict[str, dict]) -> DataFrame:
    """All declared checks as one finding table.

    ``spec[table]`` may hold ``columns``, ``not_null``, ``grain``, ``range``
    (``{col: (lo, hi)}``), ``coverage`` (``(group, key, min_n)``), ``filled``
    (``(group, col)``: groups where the column is never filled) and ``resolved``.

    All rules about single rows of a table are one aggregate over it, and rules about
    groups of the same columns share one grouped aggregate: a table is read once, plus once
    for each set of group columns, however many rules it has. Nothing runs until the findings are read.
    """
    spark = next(iter(tables.values())).sparkSession
    out = [findings(spark, [(name, "exists", None, 1) for name in spec if name not in tables])]
    for table, rules in spec.items():
        if table not in tables:
            continue
        df = tables[table]
        out.append(_tally(df, table, _row_rules(df, rules)))
        for group, judged in _group_rules(rules).items():
            groups = df.groupBy(*group).agg(*[n.alias(f"__{check}") for check, _, n, _ in judged])
            out.append(_tally(groups, table, [(check, col, F.count_if(bad)) for check, col, _, bad in judged]))
    return reduce(DataFrame.unionByName, out)


def check_rating(df: DataFrame, period: Order, entity: str, tolerance: float = 1e-6) -> DataFrame:
    """Periods with repeated entities, missing ratings or a non-zero change sum."""
    stats = df.groupBy(*as_list(period)).agg(
        (F.count(F.lit(1)) - F.count_distinct(entity)).alias("n_repeated"),
        F.count_if(F.col("rating_before").isNull()).alias("n_missing"),
        F.sum("rating_delta").alias("delta_sum"),
    )
    return stats.filter((F.col("n_repeated") > 0) | (F.col("n_missing") > 0) | (F.abs("delta_sum") > tolerance))


def raise_if_any(violations: DataFrame, message: str) -> None:
    """Raise with a few sample rows when a check found something."""
    sample = violations.limit(10).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")
