"""Run registered queries and compare them with their check SQL in DuckDB.

usage: python tools/check.py [sf folder name] [name fragment ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablewright.plans import load_all  # noqa: E402
from tablewright.session import build_session  # noqa: E402
from tablewright.sources.tables import NAMES  # noqa: E402


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    return v


def rank_key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(name, got_cols, got, exp_cols, exp):
    if sorted(got_cols) != sorted(exp_cols):
        return f"columns {sorted(got_cols)} != {sorted(exp_cols)}"
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    gi = [got_cols.index(c) for c in sorted(got_cols)]
    ei = [exp_cols.index(c) for c in sorted(exp_cols)]
    a = sorted((tuple(canon(r[i]) for i in gi) for r in got), key=rank_key)
    b = sorted((tuple(canon(r[i]) for i in ei) for r in exp), key=rank_key)
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"differs\n   spark  {str(x)[:700]}\n   duckdb {str(y)[:700]}"
    for row in a[:50]:
        for v in row:
            if not (v is None or type(v) in (int, float, str, bool)):
                return f"type {type(v)} is not a plain one: {v!r}"[:200]
    return None


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name, q in load_all().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) or q.build.__module__.endswith("." + w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, folder)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time() - t0
            if q.sql is None:
                print(f"rows {name} {len(got)} {t1:.2f}s {str(got[:1])[:120]}", flush=True)
                continue
            cur = con.execute(q.sql)
            err = compare(name, df.columns, got, [c[0] for c in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            err, t1 = f"{type(e).__name__}: {str(e)[:900]}", time.time() - t0
            got = []
        print(("ok  " if not err else "BAD ") + f"{name} {len(got)} {t1:.2f}s" + (f"  {err}" if err else ""), flush=True)
        if err:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
