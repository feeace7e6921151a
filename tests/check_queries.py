"""Run registered queries beside their SQL in DuckDB and compare all rows.

usage: python tests/check_queries.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from spanloom import session  # noqa: E402


def open_tables(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} / {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} / {sum(theirs.values())} rows\n"
        f"  only ours   {list((ours - theirs).items())[:3]}\n  only theirs {list((theirs - ours).items())[:3]}"
    )


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = session.local_session(8)
    con = open_tables(sf)
    bad = 0
    for q in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            diff = compare(spark, con, q, sf)
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {q} {time.time() - t:.1f}s" + (f"\n  {diff}" if diff else ""), flush=True)
    print("differences:", bad)
