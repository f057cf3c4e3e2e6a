"""Compare a Spark DataFrame with DuckDB SQL as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str | None = None, **tables: pa.Table):
    con = duckdb.connect()
    for name in TABLES if sf_dir else []:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, table in tables.items():
        con.register(name, table)
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def same(df, con, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    extra, lost = got - expected, expected - got
    assert not extra and not lost, f"{sum(extra.values())} extra {list(extra)[:2]}, {sum(lost.values())} lost {list(lost)[:2]}"
