"""Run registered queries next to their SQL: ``python tests/compare.py [sf_dir] [name …]``."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from defectflow.session import local_session  # noqa: E402
from defectflow.sources.demo import TABLES  # noqa: E402


def duck(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df) else df


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = ordered(ours), ordered(theirs)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and not {a[c].dtype.kind, b[c].dtype.kind} <= set("iu"):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c} differs in {int(bad.sum())} rows, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(contract.queries())
    spark, db, bad = local_session(8), duck(sf), 0
    for name in wanted:
        start = time.time()
        try:
            ours = contract.queries()[name](spark, sf).toPandas()
            spent = time.time() - start
            sql = contract.oracle_sql().get(name)
            start = time.time()
            problem = difference(ours, db.sql(sql).df()) if sql else None
            state = "rows only" if not sql else "ok"
            print(f"{'FAIL' if problem else state:9} {name:28} {len(ours):7} rows {spent:6.2f}s sql {time.time() - start:5.2f}s {(problem or '')[:600]}", flush=True)
            bad += bool(problem)
        except Exception as error:
            bad += 1
            print(f"ERROR     {name:28} {type(error).__name__}: {str(error)[:900]}", flush=True)
    sys.exit(bad > 0)
