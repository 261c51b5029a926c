"""Run every registered query on Spark and its oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema and order-insensitive value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    # exact: doubles must be bit-for-bit equal (a value hash sees every bit)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v is not None and type(v).__name__ == "Decimal":
        return float(v)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, repr(x)) for x in t))


def compare(spark, sf_dir, names=None):
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        dt = time.time() - t0
        if name not in sqls:
            results[name] = f"rows={len(srows)} (no oracle)"
            print(f"{name:40s} {results[name]} {dt:.2f}s", flush=True)
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = f"DUCK ERROR {exc}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_rows = len(srows) == len(drows)
        ok_vals = ok_cols and canon(srows, scols) == canon(drows, dcols)
        status = "OK" if ok_cols and ok_rows and ok_vals else "MISMATCH"
        results[name] = status
        print(f"{name:40s} {status} rows={len(srows)}/{len(drows)} cols={ok_cols} "
              f"vals={ok_vals} {dt:.2f}s", flush=True)
        if status != "OK":
            print("  spark:", scols, canon(srows, scols)[:5])
            print("  duck :", dcols, canon(drows, dcols)[:5])
    return results


if __name__ == "__main__":
    from cohortlens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v not in ("OK",) and "no oracle" not in v]
    print("FAILED:", bad)
