"""Compare queries with their SQL on DuckDB: python -m tests.oracle [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r]
    )


def mismatch(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> str:
    """Empty if the query and the SQL agree."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{name}: {len(mine[1])} rows and {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{name}: {len(bad)} rows differ, such as {bad[:2]}" if bad else ""


if __name__ == "__main__":
    from tests.conftest import make_session

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    session, chosen = make_session(), sys.argv[1:]
    sqls = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if chosen and not any(key.startswith(c) for c in chosen):
            continue
        began = time.time()
        if key in sqls:
            said = mismatch(session, key, fn, sqls[key]) or "same"
        else:
            said = f"rows {fn(session, SF_DIR).count()}"
        print(f"{key}: {said} ({time.time() - began:.1f} s)", flush=True)
