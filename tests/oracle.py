"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/oracle.py [sf-dir] [name-prefix ...]
"""

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


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + "|".join(_cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _kind(name: str) -> str:
    name = name.lower()
    table = {"bigint": "int", "integer": "int", "varchar": "str", "string": "str", "hugeint": "hugeint"}
    return table.get(name, name)


def compare(spark, con, fn, sql: str, sf: str) -> list[str]:
    """Differences between the two sides; empty when they agree."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
    spark_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    duck_types = {d[0]: _kind(str(d[1])) for d in cur.description}
    problems = []
    if sorted(cols) != names:
        return [f"columns: spark {names} oracle {sorted(cols)}"]
    for n in names:
        if spark_types[n] != duck_types[n]:
            problems.append(f"type of {n}: spark {spark_types[n]} oracle {duck_types[n]}")
    at = [cols.index(n) for n in names]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in rows)
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)} oracle {len(want)}")
    if got != want:
        extra, lack = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        problems.append(f"values: {len(extra)} only in spark {extra[:2]}; {len(lack)} only in oracle {lack[:2]}")
    elif not got:
        problems.append("both sides are empty")
    return problems


def main() -> int:
    from evalweave.functions.session import local_session
    from evalweave.plans.registry import all_oracles, all_queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, fn, oracles[name], sf)
            else:
                problems = [] if fn(spark, sf).collect() else ["no rows"]
        except Exception as exc:  # noqa: BLE001 - report every query
            problems = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        bad += bool(problems)
        mark = "ok  " if not problems else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - t:.1f}s", *problems, sep="\n       ", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
