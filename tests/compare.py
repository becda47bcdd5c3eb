"""Runs registered queries next to their SQL and reports where they differ.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _value(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return (0, "")
        return (1, f"{float(value):.9g}")
    return (1, str(value))


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df, connection, sql) -> list[str]:
    """Empty if the DataFrame and the SQL have the same columns and rows."""
    result = connection.execute(sql)
    want_names, want = _normal([d[0] for d in result.description], result.fetchall())
    got_names, got = _normal(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w][:5]


def main(argv) -> int:
    import __spark_entry__ as entry
    from supplypanel.session import session

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    spark = session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                found = differences(df, connection, sqls[name])
            else:
                found = [] if df.count() > 0 else ["no rows"]
        except Exception as error:  # report every query, then fail
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {name} {time.time() - start:.2f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
