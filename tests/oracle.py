"""Rows of a Spark query and of DuckDB SQL over the same tables, made comparable."""

import glob
import os

import duckdb


def norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, int):
        return value
    return round(value, 6) if isinstance(value, float) else str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return [rel.columns[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in rel.fetchall()), key=str)
