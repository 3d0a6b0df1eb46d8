"""Rows of a query and of its SQL, as comparable sorted lists."""

import glob
import os

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(repr(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in data))


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
