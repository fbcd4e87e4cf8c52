"""Comparing a registered query with its SQL on the same tables."""

import math
import os
from collections import Counter
from glob import glob

import duckdb

DATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def same(spark, query, sql, folder):
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(folder).sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
