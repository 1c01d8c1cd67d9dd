"""Run queries and their SQL on one set of tables and compare the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(row[i]) for i in order) for row in rows)


#: Spark type -> SQL type of the same values.
_SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(con, df, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_cols, want = _rows(names, cursor.fetchall())
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if want_cols != got_cols:
        return [f"columns {got_cols} != {want_cols}"]
    for name, kind in df.dtypes:
        if _SAME.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} and {types[name]}")
    if want != got:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        problems.append(f"{sum(got.values())} rows, expected {sum(want.values())}; extra {extra}; missing {missing}")
    return problems
