"""Compare registered queries with their SQL: `python tests/oracle_check.py [sf_dir] [names...]`."""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("documents", "conversations", "pages", "events", "labels", "benchmark")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    """Rows with columns by name and values as text, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def difference(con, spark, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short account of the first difference."""
    frame = query(spark, sf_dir)
    ours = canonical(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for mine, other in zip(ours, theirs, strict=True):
        if mine != other:
            pairs = [(a[:300], b[:300]) for a, b in zip(mine, other, strict=True) if a != b]
            return f"{sorted(names)} first difference: {pairs} in {[m[:40] for m in mine]}"
    return None


def main() -> None:
    from paperloom.plans.catalog import ORACLE, REGISTRY
    from paperloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark, con = local_session(8), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            found = difference(con, spark, REGISTRY[name], ORACLE[name], sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            found = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main()
