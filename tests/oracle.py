"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return plain(v.item()) if hasattr(v, "item") else v


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in r) for r in df.select(cols).collect())
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
