"""Compare a Spark result with DuckDB running the oracle SQL."""

from __future__ import annotations

import math

import duckdb

from threadlens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, repr(x)) for x in row)


def compare(spark_df, con, sql):
    """Return (ok, message) comparing names, row counts and values."""
    s_cols = spark_df.columns
    rows = spark_df.collect()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            for c, u, v in zip(order, x, y):
                if u != v and not (isinstance(u, float) and isinstance(v, float)
                                   and abs(u - v) <= 1e-4 * max(1.0, abs(u))):
                    return False, f"first diff in {c}: spark={u!r} duck={v!r}"
    return True, f"{len(a)} rows"
