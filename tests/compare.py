"""Comparing a query's rows with those of its oracle SQL."""

import datetime
import decimal
import math

import duckdb

from sparkloom.sources.tables import NAMES


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(canon, v))
    return str(v) if isinstance(v, datetime.datetime | datetime.date) else v


def connect(folder):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    mine = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert mine == theirs
