"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


def same(spark, sf_dir, make, sql):
    df = make(spark, sf_dir)
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert got == want, f"{len(got)} and {len(want)} rows; first difference: {next((p for p in zip(got, want) if p[0] != p[1]), None)}"
