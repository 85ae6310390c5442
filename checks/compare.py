"""Run registered queries against their SQL: python -m checks.compare [sf_dir] [key prefix ...]"""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

from spendwarden.session import build_session

from .views import BASE


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def main(sf_dir: str, *prefixes: str) -> int:
    from . import catalogue

    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"create view {b} as select * from '{sf_dir}/{b}.parquet'")
    bad = 0
    for key, fn in catalogue.QUERIES.items():
        if prefixes and not key.startswith(tuple(prefixes)):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = sorted(df.columns)
            got = sorted("|".join(canon(r[c]) for c in cols) for r in df.collect())
            t1 = time.time()
            if key not in catalogue.ORACLE:
                print(f"rows  {key}: {len(got)} rows, spark {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(catalogue.ORACLE[key])
            names = list(rel.columns)
            types = dict(zip(names, map(str, rel.types)))
            exp = sorted("|".join(canon(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()) if sorted(names) == cols else None
            odd = {f.name: (f.dataType.simpleString(), types.get(f.name)) for f in df.schema.fields
                   if TYPES.get(f.dataType.simpleString()) != types.get(f.name)}
            ok = got == exp
            print(f"{'ok   ' if ok else 'DIFF '} {key}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s"
                  + (f" types {odd}" if odd else ""), flush=True)
            if not ok:
                bad += 1
                if exp is None:
                    print("   columns", cols, sorted(names))
                else:
                    a, b = set(got), set(exp)
                    print("   spark", len(got), "sql", len(exp), "\n   ", cols, "\n    only spark", sorted(a - b)[:3], "\n    only sql", sorted(b - a)[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {key}: {type(e).__name__} {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*(sys.argv[1:] or ["/root/testdata/sf0.01"])) > 0)
