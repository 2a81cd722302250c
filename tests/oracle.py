"""Holds a query's rows against its SQL twin in DuckDB."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def near(a, b):
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    return a == b or numbers and abs(a - b) <= 1e-6 * max(1, abs(a))


def rows(names, records, order):
    key = lambda r: tuple((v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in r)
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in records), key=key)


def assert_same(df, sql, folder=DATA):
    got = connect(folder).execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    want, have = rows(names, got.fetchall(), order), rows(df.columns, df.collect(), order)
    assert len(want) == len(have)
    assert all(near(x, y) for a, b in zip(have, want) for x, y in zip(a, b)), next((a, b) for a, b in zip(have, want) if not all(map(near, a, b)))
