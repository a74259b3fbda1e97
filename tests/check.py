"""Run registered queries against their DuckDB counterparts.

    python tests/check.py [name ...]      (all by default; $SF_DIR picks the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([cols[i] for i in order]), sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=repr
    )


def compare(con, df, sql: str) -> str:
    got_c, got = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_c, want = canon(rel.columns, rel.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}"
    if got == want:
        return ""
    extra = sorted(set(got) - set(want), key=repr)[:3]
    missing = sorted(set(want) - set(got), key=repr)[:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only duckdb {missing}"


def main(names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from cuewise.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    q, o = queries(), oracle_sql()
    bad = 0
    for name in names or list(q):
        t0 = time.time()
        try:
            if name in o:
                err = compare(con, q[name](spark, sf_dir), o[name])
                state = "FAIL " + err[:1500] if err else "ok"
            else:
                state = f"rows {len(q[name](spark, sf_dir).collect())}"
        except Exception as e:  # report and go on
            state = "FAIL " + str(e)[:1200]
        bad += state.startswith("FAIL")
        print(f"{name:34s} {time.time() - t0:6.1f}s {state}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
