"""Rows of a query against its SQL in DuckDB, order aside."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = Counter(repr([plain(x) for x in r]) for r in df.select(*names).collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    want = Counter(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
