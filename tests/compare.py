"""Run catalog queries beside their SQL checks and compare all values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(df, con, check: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(check)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in want]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if not all(_same(a, b) for a, b in zip(g, w)):
            return f"row {g} != {w}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from logrung.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if argv and name not in argv:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                problem = compare(df, con, checks[name])
                note = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                problem, note = None, f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001 - report every query
            problem, note = error, f"FAILS {type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"@ {name:28s} {time.time() - start:6.2f}s {note[:900]}", flush=True)
    print(f"@ {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
