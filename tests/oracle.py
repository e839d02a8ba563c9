"""Rows of a Spark query and of its SQL, in one comparable form."""

import datetime as dt
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path(os.environ.get("MILLRACE_DATA", "/root/testdata"))


def _cell(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float):
        return float(f"{x:.12g}")
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return canonical([c[0] for c in got.description], got.fetchall())
