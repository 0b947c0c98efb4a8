"""Compares a query with its SQL on an independent engine."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
        return "null"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        return repr(round(float(v), 6))
    return str(v)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(map(_cell, r)) for r in pdf[names].itertuples(index=False))


def check(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    assert rows(query(spark, sf).toPandas()) == rows(con.sql(sql).df())
