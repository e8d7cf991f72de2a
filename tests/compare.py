"""Compares registered queries with their SQL in DuckDB.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from foliospark.catalog.inputs import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, run, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows, want {len(want)}; extra {extra}; missing {missing}"[:1500]
    return None if got else "no rows on either side"


def main(argv: list[str]) -> int:
    from foliospark import catalog
    from foliospark.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", cores=8)
    con = connect(folder)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, queries[name], oracles[name])
            else:
                n = queries[name](spark, folder).count()
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - started:6.1f}s "
              f"{name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
