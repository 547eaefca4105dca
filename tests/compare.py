"""Compare registered queries with their SQL, value by value.

``python tests/compare.py <sf_dir> [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def table(rows, columns):
    """Rows in a fixed order, columns sorted by name, NULLs comparable."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(left, right, limit=5):
    if len(left) != len(right):
        return [f"{len(left)} rows against {len(right)}"]
    return [f"{a} against {b}" for a, b in zip(left, right) if a != b][:limit]


def check(spark, con, query, sql, folder):
    frame = query(spark, folder)
    got = table([tuple(r) for r in frame.collect()], frame.columns)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = table(cursor.fetchall(), columns)
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(columns)}"], len(got)
    return differences(got, expected), len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    import tempfile

    from starweave.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="compare-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                found, n = check(spark, con, query, oracles[name], folder)
                note = "equal" if not found else f"DIFFERENT {found}"
            else:
                n, note = query(spark, folder).count(), "rows only"
        except Exception as error:  # report and go on with the next query
            n, note = 0, f"FAILED {str(error)[:600]}"
        print(f"{name:34} {time.time() - start:6.1f}s {n:8d} rows  {note}", flush=True)
