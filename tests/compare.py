"""Run registered queries and their SQL side by side: python -m tests.compare <sf dir> [key prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "0.0" if value == 0 else format(value, ".12g")
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str | None]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return len(got), None
    ours, theirs = set(got), set(want)
    extra = sorted(ours - theirs)[:3]
    missing = sorted(theirs - ours)[:3]
    return len(got), f"rows {len(got)} vs {len(want)}; only ours {extra}; only SQL {missing}"


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tallyloom.session import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for key, query in queries.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if key in oracles:
                n, problem = difference(spark, con, query, oracles[key], sf_dir)
            else:
                n, problem = query(spark, sf_dir).count(), None
        except Exception as error:  # noqa: BLE001 - a report of all failures is the point
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        kind = "sql " if key in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {key:34s} {n:8d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
