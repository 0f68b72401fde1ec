"""Compares a query with its SQL in DuckDB the way the driver does: same columns, same rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(([_cell(r[n]) for n in names] for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    order = sorted(range(len(got)), key=lambda i: got[i])
    return [got[i] for i in order], sorted(([_cell(r[i]) for i in order] for r in cur.fetchall()), key=repr)
