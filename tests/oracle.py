"""Compare a registered query with its SQL twin in DuckDB: columns, types, rows, values."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    return v


def differences(spark, con, folder: str, fn, sql: str, timing: dict | None = None) -> list[str]:
    """Empty when both sides agree."""
    timing = {} if timing is None else timing
    start = time.time()
    df = fn(spark, folder)
    names = sorted(df.columns)
    mine = [tuple(_cell(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    timing["spark"] = time.time() - start
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    other_types = {r[0]: r[1] for r in described}
    out = []
    if sorted(other_types) != names:
        return [f"columns {names} vs {sorted(other_types)}"]
    for n, t in df.dtypes:
        if TYPES.get(t, t) != other_types[n]:
            out.append(f"type of {n}: {t} vs {other_types[n]}")
    quoted = ", ".join('"' + n + '"' for n in names)
    other = [tuple(_cell(v) for v in r) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()]
    if len(mine) != len(other):
        out.append(f"rows {len(mine)} vs {len(other)}")
    a, b = Counter(mine), Counter(other)
    only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
    if only_a or only_b:
        out.append(f"{sum((a - b).values())} rows differ, columns {names}, spark {only_a}, sql {only_b}")
    return out
