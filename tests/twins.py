"""Runs a query and its SQL twin over the same tables and compares all values."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def database(folder=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def differences(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())
    cur = database(folder).execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    wanted = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    return list((got - wanted).items())[:3], list((wanted - got).items())[:3]
