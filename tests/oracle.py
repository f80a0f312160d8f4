"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    if os.path.isdir("/opt/oracle"):
        sys.path.append("/opt/oracle")
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else round(v, 5) + 0.0)
    if isinstance(v, int):
        return (2, float(v) if abs(v) < 2**53 else v)
    return (3, str(v))


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "integer", "long", "smallint", "tinyint", "hugeint"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    return {"varchar": "string"}.get(t, t)


def compare(spark, con, name: str, sf_dir: str, queries: dict, sql: dict) -> str:
    """'' when equal, else what differs."""
    df = queries[name](spark, sf_dir)
    got_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    got = [r.asDict() for r in df.collect()]
    if name not in sql:
        return "" if got else "no rows"
    res = con.execute(sql[name])
    want_types = {d[0]: _kind(str(d[1])) for d in res.description}
    names = list(want_types)
    want = [dict(zip(names, r)) for r in res.fetchall()]
    if sorted(got_types) != sorted(want_types):
        return f"columns {sorted(got_types)} vs {sorted(want_types)}"
    if got_types != want_types:
        return f"types {got_types} vs {want_types}"
    cols = sorted(names)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in got)
    b = sorted(tuple(_norm(r[c]) for c in cols) for r in want)
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}; only here {str(sorted(set(a) - set(b))[:2])[:600]}; only sql {str(sorted(set(b) - set(a))[:2])[:600]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, e.g. {str(diff[0])[:700]}" if diff else ""


if __name__ == "__main__":
    from rivulet.session import local_session

    import __spark_entry__ as e

    sf = f"/root/testdata/{sys.argv[1]}"
    queries, sql = e.queries(), e.oracle_sql()
    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            problem = compare(spark, con, name, sf, queries, sql)
        except Exception as exc:  # report every query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print("bad:", bad)
