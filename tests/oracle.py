"""Side-by-side comparison of a registered query and its SQL statement."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{_kind(t.value_type)}>"
    return str(t)


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else "0.0"
    if isinstance(v, list):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _rows(t: pa.Table) -> list[tuple]:
    cols = [t.column(c).to_pylist() for c in sorted(t.column_names)]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*cols)) if cols else []


def difference(spark_df, sql: str, con) -> str | None:
    """None when both sides agree in columns, types, row count and values; else a description."""
    left = spark_df.toArrow()
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} vs {sorted(right.column_names)}"
    for c in left.column_names:
        a, b = _kind(left.schema.field(c).type), _kind(right.schema.field(c).type)
        if a != b:
            return f"type of {c}: {a} vs {b}"
    lr, rr = _rows(left), _rows(right)
    if len(lr) != len(rr):
        return f"rows {len(lr)} vs {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b]
    if bad:
        return f"{len(bad)} of {len(lr)} rows differ, columns {sorted(left.column_names)}, first {bad[0]}"
    return None
