"""Side-by-side comparison of a Spark query with its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)


def rows_of_frame(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else a short account of the first differences."""
    a_names, a = rows_of_frame(query(spark, sf_dir))
    b_names, b = rows_of_sql(sf_dir, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a == b:
        return ""
    left, right = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only Spark {sorted(left - right, key=repr)[:3]}; only SQL {sorted(right - left, key=repr)[:3]}"
