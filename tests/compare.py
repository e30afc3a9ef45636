"""Compare a Spark result with the result of its SQL check."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace(" ", "T")
    return v


def _rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    out = [tuple(_plain(v) for v in row) for row in zip(*cols)]
    return names, sorted(out, key=repr)


def difference(spark_table, oracle_table) -> str | None:
    """None when equal, else what differs first."""
    names_a, a = _rows(spark_table)
    names_b, b = _rows(oracle_table)
    if names_a != names_b:
        return f"columns {names_a} vs {names_b}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{names_a}: {str(x)[:600]} vs {str(y)[:600]}"
    return None
