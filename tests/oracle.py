"""Spark rows against DuckDB rows, as sorted, normalised tuples."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def duck_rows(sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
