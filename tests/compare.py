"""Run registered queries in Spark and DuckDB and compare the results value by value.

``python tests/compare.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and not math.isinf(v):
        return round(v, 8) + 0.0
    return v


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - started
    started = time.time()
    cursor = con.execute(sql)
    theirs, their_names = cursor.fetchall(), [d[0] for d in cursor.description]
    took = f"spark {spark_seconds:.2f}s duckdb {time.time() - started:.2f}s"
    if sorted(df.columns) != sorted(their_names):
        return False, f"columns {sorted(df.columns)} != {sorted(their_names)}"
    a, b = _bag(df.columns, mine), _bag(their_names, theirs)
    if a != b:
        only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(mine)} vs {len(theirs)} rows; spark only {only_a}; sql only {only_b}"
    return True, f"{len(mine)} rows, {took}"


def main() -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = make_session(), connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in wanted:
        try:
            if name in oracles:
                ok, note = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                ok, note = True, f"no oracle, {queries[name](spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("OK  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
