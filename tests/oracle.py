"""Runs a query and its SQL on one data folder and compares rows without order."""

import datetime
import decimal
import glob
import os
from collections import Counter

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connection():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, FOLDER)
    names = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
