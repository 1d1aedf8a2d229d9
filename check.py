"""Compare every registered query with its oracle SQL: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from taufold.queries import REGISTRY
from taufold.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=sort_key)


def same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


def compare(spark, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """'' when both engines agree on columns, rows and every value."""
    q = REGISTRY[name]
    df = q.run(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return "" if mine else "no rows"
    cursor = con.execute(q.sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    if not mine:
        return "no rows"
    pairs = zip(rows_of(df.columns, mine), rows_of(names, theirs))
    bad = [(a, b) for a, b in pairs if not all(same(x, y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    failed = 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "rows" if REGISTRY[name].sql is None else "oracle"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind:6s} {time.perf_counter() - start:6.2f}s {problem}", flush=True)
        failed += bool(problem)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
