"""Runs the registered SQL in DuckDB over a folder of tables."""

import os

import duckdb


def rows(sql: str, sf_dir: str) -> list[dict]:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, x, strict=True)) for x in r.fetchall()]


def same(spark_rows, duck_rows) -> bool:
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    return sorted(map(key, (r.asDict() for r in spark_rows))) == sorted(map(key, duck_rows))
