"""Rows of a Spark query and of its DuckDB SQL in one form, so that they can be compared as multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, int):
        return x
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else int(x) if float(x).is_integer() else float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def of_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), counted(df.columns, df.collect())


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if Path(f'{sf_dir}/{t}.parquet').is_dir() else ''}')")
    return con


def of_duckdb(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    got = database(sf_dir).execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), counted(columns, got.fetchall())
