"""Runs a query and its SQL over the same tables and compares the rows as bags."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def plain(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(tuple(r[k]) if isinstance(r[k], list) else r[k] for k in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if equal."""
    columns, want = sql_rows(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = plain(map(tuple, df.collect()), df.columns), plain(want, columns)
    return "" if a == b else f"only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}; {sum(a.values())} and {sum(b.values())} rows"
