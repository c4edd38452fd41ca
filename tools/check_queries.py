"""Run registered queries and compare them with their SQL in DuckDB.

usage: python tools/check_queries.py <sf dir> [name or prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from cohortry.plans import oracle_sql, queries
from cohortry.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(got: tuple[list[str], list[tuple]], want: tuple[list[str], list[tuple]]) -> str:
    if sorted(got[0]) != sorted(want[0]):
        return f"columns differ: {sorted(got[0])} against {sorted(want[0])}"
    a, b = canonical(*got), canonical(*want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            n = sum(1 for p, q in zip(a, b) if p != q)
            return f"{n} of {len(a)} rows differ, first: {str(x)[:300]} against {str(y)[:300]}"
    return ""


def main() -> int:
    folder, names = sys.argv[1].rstrip("/"), sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duck(folder)
    todo, sql = queries(), oracle_sql()
    bad = 0
    for name, build in todo.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        begin = time.time()
        try:
            df = build(spark, folder)
            got = (df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - begin
            if name in sql:
                begin = time.time()
                cur = con.execute(sql[name])
                want = ([d[0] for d in cur.description], cur.fetchall())
                problem = compare(got, want)
                print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got[1])} rows, {spent:.2f}s, sql {time.time() - begin:.2f}s {problem}", flush=True)
                bad += bool(problem)
            else:
                print(f"rows {name}: {len(got[1])} rows, {spent:.2f}s", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:1200]}", flush=True)
    spark.stop()
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
