"""Runs registered queries beside their oracle SQL and reports differences.

    python tests/oracle.py [name-part ...] [--sf DIR]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if s.dtype == object or str(s.dtype) in ("string", "str"):
            out[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT else str(v))
        elif str(s.dtype).startswith("datetime"):
            out[c] = s.astype("datetime64[us]").astype(str)
        elif str(s.dtype) in ("bool", "boolean"):
            out[c] = s.astype(object).map(lambda v: None if pd.isna(v) else str(bool(v)))
        else:
            out[c] = s.astype("float64").map(lambda v: None if pd.isna(v) else f"{v:.9g}")
    flat = pd.DataFrame(out).astype(object)
    flat = flat.where(flat.notna(), None)
    return flat.sort_values(list(flat.columns), key=lambda s: s.map(lambda v: "" if v is None else v)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    if not a.equals(b):
        bad = (a != b) & ~(a.isna() & b.isna())
        rows = bad.any(axis=1)
        return f"{int(rows.sum())} rows differ in {[c for c in bad.columns if bad[c].any()]}\n{a[rows].head(4)}\n{b[rows].head(4)}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    from concordat.session import local_session
    import __spark_entry__ as entry

    spark = local_session("oracle", "8", **{"spark.driver.memory": "16g"})
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            t = time.time()
            mine = fn(spark, sf).toPandas()
            took = time.time() - t
            if name not in oracles:
                print(f"rows  {name} {len(mine)} {took:.2f}s", flush=True)
                continue
            t = time.time()
            theirs = con.execute(oracles[name]).fetchdf()
            diff = compare(mine, theirs)
            note = "" if kinds(mine) == kinds(theirs) else f" dtypes {[(c, x, kinds(theirs).get(c)) for c, x in kinds(mine).items() if kinds(theirs).get(c) != x]}"
            print(f"{'ok   ' if diff is None else 'DIFF '} {name} {len(mine)} {took:.2f}s oracle {time.time()-t:.2f}s{note}", flush=True)
            if diff:
                failed += 1
                print(diff, flush=True)
        except Exception as e:
            failed += 1
            print(f"ERROR {name} {type(e).__name__}: {str(e)[:1500]}", flush=True)
            if not isinstance(e, duckdb.Error) and "pyspark" not in type(e).__module__:
                traceback.print_exc()
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
