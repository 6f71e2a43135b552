"""Compare queries with their SQL twins in DuckDB: ``python -m tests.oracle_check [sf] [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


KINDS = {"bigint": "int", "integer": "int", "int": "int", "smallint": "int", "hugeint": "huge", "varchar": "string", "string": "string"}


def compare(df, con, sql):
    rel = con.sql(sql)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    theirs = normal(list(rel.columns), rel.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    types = dict(df.dtypes)
    kinds = dict(zip(rel.columns, [str(t).lower() for t in rel.types], strict=True))
    odd = {c: (types[c], kinds[c]) for c in types if KINDS.get(types[c], types[c]) != KINDS.get(kinds[c], kinds[c])
           and not kinds[c].startswith(types[c].split("(")[0])}
    bad = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours[1])} rows differ, e.g.\n   ours   {bad[0][0]}\n   theirs {bad[0][1]}\n   columns {ours[0]}"
    if odd:
        return f"types differ {odd}"
    return None


def main() -> None:
    from slabmill.catalog import oracle_sql, queries
    from slabmill.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", "8", 8)
    con = connect(folder)
    sql = oracle_sql()
    good = failed = 0
    for name, build in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else f"(no sql) rows={len(df.collect())}"
        except Exception:  # noqa: BLE001
            problem = "ERROR " + traceback.format_exc()[-1500:]
        took = time.time() - start
        if problem is None:
            good += 1
            print(f"ok   {name} {took:.1f}s", flush=True)
        elif problem.startswith("(no sql)"):
            print(f"rows {name} {problem} {took:.1f}s", flush=True)
        else:
            failed += 1
            print(f"FAIL {name} {took:.1f}s: {problem}", flush=True)
        spark.catalog.clearCache()
    print(f"{good} match, {failed} fail")


if __name__ == "__main__":
    main()
