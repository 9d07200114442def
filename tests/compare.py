"""Side-by-side run of a named query and its SQL twin."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TEST_DATA = "/root/testdata"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(spark, build, sql: str, folder: str) -> str | None:
    """None when both sides agree in column names, types, row count and values."""
    left, right = build(spark, folder).toArrow(), duck(folder).execute(sql).to_arrow_table()
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} / {sorted(right.column_names)}"
    for n in names:
        a, b = str(left.schema.field(n).type), str(right.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            return f"type of {n}: {a} / {b}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} / {right.num_rows}"
    rows = [
        sorted(zip(*[t.column(n).to_pylist() for n in names]), key=_key) for t in (left, right)
    ]
    for a, b in zip(*rows):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"first difference\n  {dict(zip(names, a))}\n  {dict(zip(names, b))}"
    return None
