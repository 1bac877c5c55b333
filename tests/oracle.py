"""Compares a query with its SQL: same columns, same rows in any order."""

import glob
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def same(spark, sf_dir, make, sql):
    df = make(spark, sf_dir)
    expected = views(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(expected.fetchall(), expected.columns)
