"""Reconciliation of names between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.scalars import normalize_key
from leaguelens.operators.aggregates import string_agg
from leaguelens.operators.common import Order, as_list
from leaguelens.operators.joins import join_anti
from leaguelens.operators.sets import union_tagged


def source_name_reconciliation(sources: dict[str, DataFrame], keys: Order, name: str) -> DataFrame:
    """Distinct names per source side by side; long lists go on in the next ``part``."""
    keys = as_list(keys)
    merged = union_tagged({s: df.select(*keys, name) for s, df in sources.items()})
    merged = merged.withColumn(name, normalize_key(F.col(name)))
    listed = string_agg(merged, [*keys, "source"], name, name="__names")
    cells = [F.max(F.when(F.col("source") == s, F.col("__names"))).alias(f"{s}_names") for s in sources]
    return listed.groupBy(*keys, "part").agg(*cells)


def unresolved_names(rows: DataFrame, dim: DataFrame, name: str, dim_name: str) -> DataFrame:
    """Names the dimension does not know, in normal form."""
    seen = rows.select(normalize_key(F.col(name)).alias(name)).distinct()
    known = dim.select(normalize_key(F.col(dim_name)).alias(name))
    return join_anti(seen, known, name)
