"""Run registered queries against their SQL in DuckDB: python tests/check_oracles.py [sf dir] [name part ...]"""
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from revtrace.plans.views import TABLES  # noqa: E402


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(round(f, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    return got, want


def main():
    import __spark_entry__ as entry
    from revtrace.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            if name not in oracles:
                print(f"---- {name}: {queries[name](spark, sf_dir).count()} rows, no SQL ({time.time() - t0:.1f}s)", flush=True)
                continue
            got, want = compare(spark, con, sf_dir, queries[name], oracles[name])
            ok = got == want
            print(f"{'ok  ' if ok else 'BAD '} {name}: {len(got[1])} / {len(want[1])} rows ({time.time() - t0:.1f}s)", flush=True)
            if not ok:
                bad += 1
                print("   columns", got[0], want[0])
                gs, ws = set(got[1]), set(want[1])
                for r in list(gs - ws)[:3]:
                    print("   spark only ", str(r)[:400])
                for r in list(ws - gs)[:3]:
                    print("   oracle only", str(r)[:400])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
