"""Compare a Spark result with the SQL result over the same tables: names, rows, values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{Path(sf_dir) / table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, as text; empty when the results are the same."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected_types = [str(d[1]) for d in result.description]
    expected = result.fetchall()
    found = spark_df.collect()
    problems = []
    if sorted(spark_df.columns) != sorted(expected_columns):
        return [f"columns {sorted(spark_df.columns)} instead of {sorted(expected_columns)}"]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wanted = dict(zip(expected_columns, expected_types, strict=True))
    for name, kind in spark_df.dtypes:
        if kinds.get(kind) != wanted[name]:
            problems.append(f"type of {name}: {kind} instead of {wanted[name]}")
    a = _sorted_rows(spark_df.columns, found)
    b = _sorted_rows(expected_columns, expected)
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        problems.append(
            f"{len(a)} rows instead of {len(b)}; only here {len(only_a)}: {sorted(only_a)[:2]}, "
            f"only there {len(only_b)}: {sorted(only_b)[:2]}"
        )
    return problems
