"""Compare registered queries with their SQL in DuckDB: python check.py [name-prefix ...] [--sf 0.01]."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from shoplens.plans import all_oracles, all_queries  # noqa: E402
from shoplens.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    if value is not None and type(value).__name__ == "Decimal":
        return f"decimal {value}"
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = build_session(), connect(folder)
    oracles, bad = all_oracles(), 0
    for name, fn in all_queries().items():
        if args.names and not any(name == n or name.startswith(n + "_") or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            note = "rows only"
            if name in oracles:
                start = time.time()
                cols, theirs = oracle_rows(con, oracles[name])
                sql_spent = time.time() - start
                mine, other = table(df.columns, rows), table(cols, theirs)
                if mine[0] != other[0]:
                    note, bad = f"COLUMNS {mine[0]} vs {other[0]}", bad + 1
                elif mine[1] == other[1]:
                    note = f"same (sql {sql_spent:.1f}s)"
                else:
                    a, b = [r for r in mine[1] if r not in set(map(tuple, other[1]))][:3] if len(mine[1]) < 5000 else mine[1][:2], other[1][:2]
                    if len(mine[1]) == len(other[1]):
                        pairs = [(x, y) for x, y in zip(mine[1], other[1]) if x != y]
                        a, b = [p[0] for p in pairs[:2]], [p[1] for p in pairs[:2]]
                        note = f"VALUES differ in {len(pairs)} rows\n   spark {a}\n   sql   {b}"
                    else:
                        note = f"ROWS {len(mine[1])} vs {len(other[1])}\n   spark {a}\n   sql   {b}"
                    bad += 1
            print(f"{name:44s} {len(rows):8d} rows {spent:6.1f}s  {note}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:44s} FAILED {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
