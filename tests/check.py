"""Compare registered queries with their SQL: python tests/check.py <sf_dir> [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when the results agree, else what differs."""
    import __spark_entry__ as contract

    found = contract.queries()[name](spark, sf_dir)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(found.columns):
        return f"columns {sorted(found.columns)} != {sorted(columns)}"
    ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
    theirs = rows_of(columns, cursor.fetchall())
    if ours == theirs:
        return None
    extra = [r for r in ours if r not in set(theirs)][:2] if len(ours) < 50000 else ours[:1]
    missing = [r for r in theirs if r not in set(ours)][:2] if len(ours) < 50000 else theirs[:1]
    return f"{len(ours)} rows != {len(theirs)} rows; only ours {str(extra)[:600]}; only theirs {str(missing)[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as contract
    from reqsieve.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(), connect(sf_dir), []
    for name in names or contract.queries():
        if name not in contract.oracle_sql():
            print(name, "no SQL", contract.queries()[name](spark, sf_dir).count())
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
