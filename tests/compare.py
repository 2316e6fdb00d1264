"""Comparison of a query's rows with those of its DuckDB SQL on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, cell(v)) for k, v in x.items())
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        db.execute("set timezone = 'UTC'")
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        return sorted(columns), rows_of(columns, found.fetchall())


def check(spark, query, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and equal rows; returns how many there are."""
    df = query(spark, sf_dir)
    columns, want = oracle_rows(sf_dir, sql)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{missing.total()} missing, {extra.total()} extra: {list(missing)[:2]} / {list(extra)[:2]}"
    return want.total()
