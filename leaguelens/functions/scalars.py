"""Scalar functions (F1-F31): ``Column -> Column``, all built-in expressions."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(c: Column) -> Column:
    """F1 F2: trimmed lower-case join key."""
    return F.lower(F.trim(c))


def normalize_ws(c: Column) -> Column:
    """trim, lower-case, collapse runs of blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def prefix_int(c: Column, n: int) -> Column:
    """the first ``n`` characters as a number; NULL when they are none."""
    return F.substring(c, 1, n).try_cast("int")


def label(a: Column, sep: str, b: Column) -> Column:
    """``2026 R7`` style label."""
    return F.concat(a.cast("string"), F.lit(sep), b.cast("string"))


def contains(c: Column, part: str) -> Column:
    """substring test."""
    return c.contains(part)


def matches(c: Column, pattern: str) -> Column:
    """case-insensitive regex search; NULL counts as no match."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def starts_with(c: Column, prefix: str) -> Column:
    """F8."""
    return c.startswith(prefix)


def parse_ts_utc(c: Column) -> Column:
    """ISO text to a UTC timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(c)


def parse_ts_fmt(c: Column, fmt: str = "M/d/yyyy H:mm") -> Column:
    """text in a fixed format to a timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(c, F.lit(fmt))


def epoch_seconds(c: Column) -> Column:
    """whole seconds since 1970-01-01 UTC."""
    return F.unix_seconds(c.cast("timestamp"))


def time_id(season: Column, num: Column) -> Column:
    """sortable ``season * 100 + num``."""
    return season * 100 + num


def round_half_up(c: Column, digits: int = 2) -> Column:
    """F16: SQL rounding."""
    return F.round(c, digits)


def round_half_even(c: Column, digits: int = 2) -> Column:
    """F16: banker's rounding, as data frames round."""
    return F.bround(c, digits)


def safe_divide(a: Column, b: Column) -> Column:
    """NULL over zero."""
    return F.try_divide(a, b)


def expected_score(own: Column, other: Column) -> Column:
    """logistic expectation of ``own`` beating ``other``."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))


def is_infinite(c: Column) -> Column:
    """F20."""
    return c.isin(math.inf, -math.inf)


def clip_low(c: Column, lo: float = 0.0) -> Column:
    """at least ``lo``; NULL stays NULL."""
    return F.when(c < lo, F.lit(lo)).otherwise(c)


def to_number(c: Column) -> Column:
    """text to double, NULL when it is no number."""
    return c.try_cast("double")


def element(c: Column, i: int) -> Column:
    """array element, NULL past the end."""
    return F.get(c, F.lit(i))


def rows_of(*cols: Column) -> Column:
    """several columns as rows."""
    return F.explode(F.array(*cols))


def json_field(c: Column, schema: str, field: str) -> Column:
    """one field of a JSON record."""
    return F.from_json(c, schema).getField(field)


def map_values(c: Column, aliases: dict[str, str]) -> Column:
    """replace known values, keep the rest."""
    if not aliases:
        return c
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
    return F.coalesce(F.try_element_at(lookup, c), c)


def nan_to_null(c: Column) -> Column:
    """NaN from a data frame becomes NULL."""
    return F.when(~F.isnan(c), c)
