"""Compare registered queries with their SQL on the given tables."""

from __future__ import annotations

import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from workload.queries import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, con, name: str, sf_dir: str):
    """(spark rows, sql rows, first difference or None)."""
    df = entry.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    want = _rows(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return len(got), len(want), (sorted(df.columns), sorted(columns))
    if len(got) != len(want):
        return len(got), len(want), "row count"
    for g, w in zip(got, want):
        if g != w:
            return len(got), len(want), (g, w)
    return len(got), len(want), None


def main() -> int:
    from tests.conftest import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(entry.queries())
    spark, con, bad = build_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            n, m, diff = compare(spark, con, name, sf_dir)
        except Exception as error:
            n, m, diff = -1, -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:28} {n:7} {m:7} {time.time() - start:6.2f}s", "" if diff is None else str(diff)[:900], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
