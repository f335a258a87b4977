"""Compares a registered query with its SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(_norm(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def check(spark, query, sql, sf_dir="/root/testdata/sf0.01"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql).to_arrow_table()
    got = query(spark, sf_dir).toArrow()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b
    assert len(x) == len(y)
    assert x == y
