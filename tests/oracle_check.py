"""Compare every registered Spark query with its DuckDB oracle (like the driver).

Usage: python tests/oracle_check.py [sf_dir] [name,name,...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.oracle import oracle_queries  # noqa: E402
from tessera.plans.registry import registry  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    from tessera.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    oq = oracle_queries()
    bad = 0
    for name, fn in registry().items():
        if names and name not in names:
            continue
        if name not in oq:
            print(f"NO-ORACLE {name}")
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-FAIL {name}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        try:
            rel = con.sql(oq[name])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"DUCK-FAIL {name}: {str(e)[:600]}")
            bad += 1
            continue
        t2 = time.time()
        stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        otypes = dict(zip(ocols, [str(t) for t in rel.types]))
        norm = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "int": "INTEGER"}
        bad_types = {c: (stypes[c], otypes.get(c)) for c in stypes
                     if norm.get(stypes[c], stypes[c]) != otypes.get(c)}
        if bad_types:
            print(f"   TYPES {name}: {bad_types}")
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        tag = "MATCH" if ok else "DIFF"
        print(f"{tag} {name} rows={len(srows)}/{len(orows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
        if not ok:
            bad += 1
            if sorted(scols) != sorted(ocols):
                print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(ocols))
            else:
                diff_s = [x for x in ls if x not in set(lo)][:3]
                diff_o = [x for x in lo if x not in set(ls)][:3]
                print("   spark-only:", diff_s, "\n   duck-only: ", diff_o)
    print("bad", bad)


if __name__ == "__main__":
    main()
