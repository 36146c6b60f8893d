"""Run a registered query and its SQL counterpart and compare them as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else a short description of where they do not."""
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    if sorted(spark_df.columns) != sorted(sql_names):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(sql_names)}"
    ours, theirs = _bag(spark_df.columns, spark_df.collect()), _bag(sql_names, cursor.fetchall())
    if ours == theirs:
        return None
    return (
        f"{ours.total()} vs {theirs.total()} rows; only here {list((ours - theirs).items())[:2]}; "
        f"only there {list((theirs - ours).items())[:2]}"
    )
