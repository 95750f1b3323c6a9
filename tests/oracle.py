"""Holds a query's rows against DuckDB's on the same tables."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def run_sql(sql: str, sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return x if isinstance(x, int) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, sf: str = SF):
    names, data = run_sql(sql, sf)
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, data)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, (g, w)
