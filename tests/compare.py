"""Rows of a Spark query against those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def same(spark, query, sql, folder, con):
    df = query(spark, folder)
    names = sorted(df.columns)
    left = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    right = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert left == right
