"""Run registered queries in Spark and their SQL twins in DuckDB and compare
(row count, column names, order-insensitive values), like the driver does.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:400])
            if verbose:
                print(f"{name}: SPARK_ERROR {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e)[:400])
            if verbose:
                print(f"{name}: SQL_ERROR {str(e)[:400]}")
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = _rows(scols, srows), _rows(dcols, drows)
        ok = ok_cols and a == b
        results[name] = ("MATCH" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name}: {'MATCH' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} ({ts:.1f}s)")
            if not ok_cols:
                print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(dcols))
            elif not ok:
                sa, sb = set(a), set(b)
                print("   only spark:", sorted(sa - sb)[:3], "\n   only duck: ", sorted(sb - sa)[:3])
    return results


if __name__ == "__main__":
    from siftwork.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("MATCH", "ROWS_ONLY")]
    print("SUMMARY:", len(res), "queries,", len(bad), "not matching:", bad)
