"""Runs a query and its SQL on the same tables and compares sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    a, b = got.columns, rel.columns
    assert sorted(a) == sorted(b), (name, a, b)
    x, y = rows_of(a, got.collect()), rows_of(b, rel.fetchall())
    assert len(x) == len(y), (name, len(x), len(y))
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    assert not bad, (name, len(bad), bad[:3])
    return len(x)
