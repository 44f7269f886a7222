"""Rows of a query and of its SQL in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'") if glob.glob(p) else None
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(rows, names) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def both(spark, c, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = table([tuple(r) for r in df.collect()], df.columns)
    cur = c.execute(sql)
    return mine, table(cur.fetchall(), [x[0] for x in cur.description])
