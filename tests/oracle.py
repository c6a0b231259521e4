"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return float(v) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return table(columns, cursor.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True)
           if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
