"""Comparison of a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def differences(actual: pa.Table, expected: pa.Table) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    found = []
    if sorted(actual.column_names) != sorted(expected.column_names):
        return [f"columns {sorted(actual.column_names)} != {sorted(expected.column_names)}"]
    for name in actual.column_names:
        a, e = actual.schema.field(name).type, expected.schema.field(name).type
        if a != e and not (pa.types.is_string(a) or pa.types.is_large_string(a)):
            found.append(f"type of {name}: {a} != {e}")
    if actual.num_rows != expected.num_rows:
        return [*found, f"rows {actual.num_rows} != {expected.num_rows}"]
    a, e = _rows(actual), _rows(expected)
    wrong = [(x, y) for x, y in zip(a, e) if x != y]
    if wrong:
        found.append(f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}")
    return found


def expected(connection: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return connection.sql(sql).to_arrow_table()


def haversine(lat1, lon1, lat2, lon2):
    dlat, dlon = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    chord = math.sin(dlat / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(chord)))
