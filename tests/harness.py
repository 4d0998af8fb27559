"""Spark-vs-DuckDB comparison used by the oracle tests and ``tools/check_oracle.py``.

Row count, column names and an order-insensitive hash of the values
(floats rounded to 6 decimals, temporal values as ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

from barlake.sources.tables import DRIVER_TABLES, table_path


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_digest(columns: list[str], rows: list[tuple]) -> tuple[int, str, list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normed = sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows))
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return len(rows), h, normed


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(df, con, sql, show: int = 5) -> dict:
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(con, sql)
    sn, sh, snorm = rows_digest(scols, srows)
    dn, dh, dnorm = rows_digest(dcols, drows)
    out = {"spark_rows": sn, "duck_rows": dn, "cols_match": sorted(scols) == sorted(dcols),
           "hash_match": sh == dh and sorted(scols) == sorted(dcols)}
    if not out["hash_match"]:
        out["spark_cols"] = sorted(scols)
        out["duck_cols"] = sorted(dcols)
        sset, dset = set(snorm), set(dnorm)
        out["only_spark"] = sorted(sset - dset)[:show]
        out["only_duck"] = sorted(dset - sset)[:show]
    return out
