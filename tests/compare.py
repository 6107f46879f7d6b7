"""A query's rows against those of its DuckDB equivalent."""

from __future__ import annotations

import math
from pathlib import Path


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in got.fetchall()), key=repr)
