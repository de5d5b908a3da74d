"""Compares a query with its SQL counterpart run by DuckDB on the same files."""

from __future__ import annotations

import math

import duckdb

from leaguelens.sources.tables import SCHEMAS


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    return str(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count or values; empty when equal."""
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    cols = sorted(rel.columns)
    out = []
    if sorted(df.columns) != cols:
        return [f"columns {sorted(df.columns)} != {cols}"]
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    for f in df.schema:
        got = names.get(f.dataType.simpleString(), f.dataType.simpleString())
        if got != types[f.name]:
            out.append(f"type of {f.name}: {got} != {types[f.name]}")
    order = ", ".join(f'"{c}"' for c in cols)
    want = sorted([tuple(map(_text, r)) for r in con.sql(f"SELECT {order} FROM ({sql})").fetchall()])
    have = sorted([tuple(map(_text, (r[c] for c in cols))) for r in df.collect()])
    if len(want) != len(have):
        out.append(f"rows {len(have)} != {len(want)}")
    bad = [(a, b) for a, b in zip(have, want, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first spark={bad[0][0]} sql={bad[0][1]}")
    if not want:
        out.append("empty result")
    return out
