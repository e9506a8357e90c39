"""Rows of a query and of its SQL, in a form that compares."""

import datetime
import decimal
from pathlib import Path

import duckdb


def cell(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def database(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def sql_rows(c, sql):
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(cell(x[i]) for i in order) for x in r.fetchall())
