"""Side-by-side check of every registered query against its DuckDB oracle.

``python -m svcops.plans.check /root/testdata/sf0.01 [key ...]`` prints one
line per key: row counts, column names and an order-insensitive comparison
of the values (columns sorted by name, like the driver's check).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def duckdb_connection(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    out.sort(key=_key)
    return cols, out


def compare_one(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t_spark = time.time() - t0
    res = {"key": key, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    res["oracle_rows"] = len(orows)
    sc, sv = canonical(scols, srows)
    oc, ov = canonical(ocols, orows)
    if sc != oc:
        res["status"] = f"COLUMNS {sc} vs {oc}"
    elif len(sv) != len(ov):
        res["status"] = "ROWCOUNT"
    elif sv != ov:
        diffs = [(a, b) for a, b in zip(sv, ov) if a != b][:3]
        res["status"] = f"VALUES {diffs}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    from svcops.plans.registry import oracle_sql, queries
    from svcops.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_spark()
    con = duckdb_connection(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for key in keys or list(qs):
        try:
            r = compare_one(spark, con, sf_dir, key, qs[key], os_.get(key))
        except Exception as e:  # report and go on
            r = {"key": key, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        bad += r["status"] not in ("ok", "no-oracle")
        print(r, flush=True)
    print(f"{bad} problem(s) in {len(keys or qs)} keys")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
