"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import sys
import time

import duckdb

from curbledger.plans.registry import REGISTRY
from curbledger.session import local_session
from curbledger.sources.fixtures import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[int, int, list, list, list, list]:
    """Row counts, column lists, and up to three rows found on one side only."""
    query = REGISTRY[name]
    frame = query.frame(spark, sf_dir)
    ours = sorted(repr(tuple(row)) for row in frame.collect())
    cursor = con.execute(query.oracle())
    columns = [c[0] for c in cursor.description]
    theirs = sorted(repr(row) for row in cursor.fetchall())
    if ours == theirs:
        return len(ours), len(theirs), frame.columns, columns, [], []
    a, b = set(ours), set(theirs)
    only = sorted(a - b)[:3], sorted(b - a)[:3]
    return len(ours), len(theirs), frame.columns, columns, only[0] or ["(multiplicity)"], only[1]


if __name__ == "__main__":
    sf = sys.argv[1]
    names = sys.argv[2:] or list(REGISTRY)
    session = local_session()
    db = connect(sf)
    for item in names:
        start = time.time()
        if REGISTRY[item].sql is None:
            print(item, "rows only:", REGISTRY[item].frame(session, sf).count(), f"{time.time() - start:.1f}s", flush=True)
            continue
        try:
            n, m, cols, their_cols, left, right = compare(session, db, sf, item)
            ok = not left and not right and cols == their_cols
            print("OK  " if ok else "DIFF", item, n, m, f"{time.time() - start:.1f}s", flush=True)
            if not ok:
                print("   spark:", left, "\n   duckdb:", right, flush=True)
        except Exception as error:  # report and go on with the next query
            print("FAIL", item, str(error)[:1500], flush=True)
