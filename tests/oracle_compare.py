"""Run registered Spark queries and their DuckDB oracle side by side.

    python tests/oracle_compare.py [sf_dir] [key-substring ...]

Prints, per key: row counts, column names, and whether the sorted rows agree.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, f"{round(v, 4):.4f}")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, (int,)):
        return (1, f"{float(v):.4f}")
    if hasattr(v, "item"):
        return norm(v.item())
    return (1, str(v))


def duck_con(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    import __spark_entry__ as E
    from revisionlens.session import get_spark
    spark = get_spark(8)
    con = duck_con(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if pats and not any(p in k for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k}: SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k}: rows={len(rows)} (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(sqls[k])
            dcols = [d[0] for d in res.description]
            dtypes = {d[0]: str(d[1]).upper() for d in res.description}
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k}: DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        td = time.time() - t1
        ok_cols = sorted(cols) == sorted(dcols)
        if ok_cols:
            order = [dcols.index(c) for c in cols]
            drows = [tuple(r[i] for i in order) for r in drows]
        a = sorted(tuple(norm(v) for v in r) for r in rows)
        b = sorted(tuple(norm(v) for v in r) for r in drows)
        ok = ok_cols and a == b
        bad += 0 if ok else 1
        tmap = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}
        stypes = {f.name: tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        tdiff = {c: (stypes[c], dtypes.get(c)) for c in stypes if c in dtypes and stypes[c] != dtypes[c]}
        print(f"{k}: {'OK ' if ok else 'DIFF'} spark={len(rows)} duck={len(drows)} "
              f"cols={'ok' if ok_cols else (cols, dcols)} {ts:.1f}s/{td:.1f}s"
              + (f" TYPES {tdiff}" if tdiff else ""))
        if not ok and ok_cols:
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck: ", list(sb - sa)[:3])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
