"""Run queries beside their SQL: ``python tests/oracle.py [folder] [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark, con, folder, name, query, sql) -> str | None:
    """None when both agree, otherwise what differs."""
    got = query(spark, folder).toPandas()
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    left, right = canonical(got), canonical(want)
    if left == right:
        kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
        return f"kinds {kinds}" if kinds and all(len(set(k)) > 1 for k in kinds.values()) and not got.isna().any().any() else None
    extra, missing = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
    return f"rows {len(left)} vs {len(right)}; extra {str(extra)[:400]}; missing {str(missing)[:400]}"


if __name__ == "__main__":
    from penprint.session import local_session
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    chosen = {n: q for n, q in queries().items() if len([a for a in sys.argv[2:] if a != "-v"]) == 0 or n in sys.argv[2:]}
    for name, query in chosen.items():
        begin = time.time()
        try:
            problem = compare(spark, con, folder, name, query, oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - begin
        bad += problem is not None
        if problem or took > 5 or "-v" in sys.argv:
            print(f"{'FAIL' if problem else 'ok'} {name} {took:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
