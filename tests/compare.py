"""Run a registered analysis and its SQL text on the same files and compare."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        assert not math.isnan(v), "NaN in a result"
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def mismatch(spark, con, query, sql, folder) -> str | None:
    t = time.time()
    df = query(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    cols, got = rows_of(df.columns, spark_rows)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]} ({took:.1f} s)"
    return None
