"""Compares a Spark result with DuckDB's, as multisets of rows; floats to six decimals."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6)
        return int(v) if v == int(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, sf):
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        found = c.execute(sql)
        return sorted(x[0] for x in found.description), rows([x[0] for x in found.description], found.fetchall())


def check(df, sql, sf):
    columns, want = duck_rows(sql, sf)
    assert sorted(df.columns) == columns
    got = spark_rows(df)
    assert len(got) == len(want)
    assert got == want
