"""Spark results against DuckDB results over the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def duck_rows(sql: str, sf_dir: str) -> list[dict]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, x, strict=True)) for x in r.fetchall()]


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime | datetime.date):
        return str(x)
    return x if x is None or isinstance(x, bool | int | str) else str(x)


def number(x: str | int) -> str:
    return f"{float(x):.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def differences(spark_rows: list[dict], duck: list[dict]) -> str | None:
    if spark_rows and duck and set(spark_rows[0]) != set(duck[0]):
        return f"columns {sorted(spark_rows[0])} and {sorted(duck[0])}"
    key = lambda r: [number(plain(r[k])) for k in sorted(r)]
    a, b = sorted(map(key, spark_rows)), sorted(map(key, duck))
    if a == b:
        return None
    odd = next((x, y) for x, y in zip([*a, None], [*b, None], strict=False) if x != y)
    return f"{len(a)} and {len(b)} rows; first difference {odd}"
