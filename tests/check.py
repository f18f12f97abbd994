"""python -m tests.check [sf] [name ...]: compare queries with their oracles and print the differences."""
from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from alertloom.session import local_session
from tests.harness import compare

if __name__ == "__main__":
    path = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, path)
            if name in oracles:
                found = compare(df, oracles[name], path)
                rows = -1
            else:
                rows = df.count()
                found = None
        except Exception as exc:  # noqa: BLE001
            found, rows = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        mark = "ok " if found is None else "BAD"
        print(f"{mark} {name} rows={rows} {time.time() - began:.1f}s {'' if name in oracles else '(no oracle)'}", flush=True)
        if found:
            bad.append(name)
            print(found, flush=True)
    print("bad:", bad)
