"""Comparison of a query's rows with those of its SQL equivalent."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    if getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)


def sql_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
