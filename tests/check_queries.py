"""Run registered queries beside their SQL in DuckDB: python tests/check_queries.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fairline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, dict):
        return str(sorted((str(k), canonical(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, folder, name, connection):
    started = time.time()
    frame = entry.queries()[name](spark, folder)
    mine, my_columns = rows_of(frame.columns, frame.collect())
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(mine), seconds, None, None
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs, their_columns = rows_of(columns, cursor.fetchall())
    if my_columns != their_columns:
        return len(mine), seconds, False, (my_columns, their_columns)
    same = mine == theirs
    difference = None
    if not same:
        ours, others = set(mine), set(theirs)
        difference = (len(mine), len(theirs), list(ours - others)[:3], list(others - ours)[:3])
    return len(mine), seconds, same, difference


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            count, seconds, same, difference = compare(spark, folder, name, connection)
            verdict = "rows" if same is None else ("ok" if same else "DIFF")
            print(f"{verdict:5} {name:28} {count:8} {seconds:7.2f}s", difference or "", flush=True)
            bad += same is False
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            bad += 1
            print("ERROR", name, str(error)[:1500], flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
