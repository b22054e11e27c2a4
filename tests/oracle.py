"""Compare queries with their SQL on the same tables, the way a checker would."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, con, name, q, sf, limit=3):
    """(ok, message) for one query."""
    df = q.run(spark, sf)
    got, gcols = _rows(df.columns, [tuple(r) for r in df.collect()])
    if not q.sql:
        return True, f"{len(got)} rows (no SQL)"
    cur = con.execute(q.sql)
    want, wcols = _rows([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return False, f"columns {gcols} vs {wcols}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(g - w)[:limit]}; only sql {sorted(w - g)[:limit]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from offerlens.plans.catalog import load_queries
    from offerlens.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(cores="8")
    con = connect(sf)
    bad = 0
    for name, q in load_queries().items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, name, q, sf)
        except Exception as exc:
            ok, msg = False, "".join(traceback.format_exception_only(type(exc), exc))[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg[:1800]}", flush=True)
    print("failures:", bad)
