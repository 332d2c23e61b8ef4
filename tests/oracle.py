"""Comparison of a query's rows with DuckDB's, without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return repr([_value(x) for x in v])
    return repr(v) if isinstance(v, str) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def same(df, con, sql: str):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(relation.columns, relation.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
