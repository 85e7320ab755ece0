"""Compare registered queries with their SQL on the given tables: python tests/oracle_check.py SF_DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = as_rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] == theirs[1]:
        return None
    left, right = set(map(repr, mine[1])), set(map(repr, theirs[1]))
    only = sorted(left - right)[:1], sorted(right - left)[:1]
    return f"{len(mine[1])} / {len(theirs[1])} rows, {len(left - right)} / {len(right - left)} differ, e.g. {only}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagetide.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    session = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sqls = entry.oracle_sql()
    for key, run in entry.queries().items():
        if names and key not in names:
            continue
        began = time.time()
        try:
            outcome = compare(session, connection, key, run, sqls[key], folder) if key in sqls else "no sql"
        except Exception as problem:
            outcome = f"{type(problem).__name__}: {str(problem)[:1200]}"
        print(f"{key:28s} {time.time() - began:6.2f}s {(outcome or 'equal')[:2500]}", flush=True)
