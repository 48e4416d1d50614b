"""Run registered queries against their SQL twins: ``python tests/oracle_check.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        f = float(v)
        return 0.0 if f == 0 else f
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    theirs = rel.fetchall()
    ours = [tuple(r) for r in df.collect()]
    cols = sorted(df.columns)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    pick = lambda rows, src: sorted(
        (tuple(plain(r[src.index(c)]) for c in cols) for r in rows),
        key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    a, b = pick(ours, df.columns), pick(theirs, names)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {cols}: {bad[0]}" if bad else None


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from assayer.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if len(sys.argv) > 1 and not any(a in name for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
