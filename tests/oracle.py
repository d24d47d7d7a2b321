"""Spark-vs-DuckDB comparison for registered queries.

Usable from pytest and as a script:
    python tests/oracle.py [--sf /root/testdata/sf0.01] [key ...]
Columns are compared by name (sorted), rows as a multiset; floats are
compared after rounding to 6 decimals.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if v != v:
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [names[i] for i in order], out


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E
    q = E.queries()[key]
    sql = E.oracle_sql().get(key)
    t = time.time()
    sdf = q(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    took = time.time() - t
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(took, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connect(sf_dir)
    cur = con.execute(sql)
    d_names = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    sn, sr = _rows(s_names, s_rows)
    dn, dr = _rows(d_names, d_rows)
    res["oracle_rows"] = len(dr)
    if sn != dn:
        res["status"] = "schema-mismatch"
        res["detail"] = {"spark": sn, "oracle": dn}
    elif sr != dr:
        res["status"] = "value-mismatch"
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["detail"] = {"spark_only": repr(diff_s)[:600], "oracle_only": repr(diff_d)[:600]}
    else:
        res["status"] = "match"
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    from tidepool.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connect(a.sf)
    keys = a.keys or sorted(E.queries())
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, a.sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "error", "detail": f"{type(e).__name__}: {str(e)[:800]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"checked": len(keys), "failing": bad}))


if __name__ == "__main__":
    main()
