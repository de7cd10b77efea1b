"""Compare registered queries with their SQL on DuckDB: rows, column names, types and values.

Usage: python tests/check_oracle.py [sf dir] [query ...]
"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from logsieve.session import local_session  # noqa: E402

KINDS = {"int32": "int", "int64": "bigint", "Int32": "int", "Int64": "bigint", "float64": "double"}

SPENT = {}


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def arrow_kinds(table):
    return {f.name: str(f.type).replace("large_string", "string").replace("date64", "date") for f in table.schema}


def normal(table):
    table = table.select(sorted(table.column_names))
    frame = table.to_pandas()
    return frame.sort_values(list(frame.columns), kind="stable", na_position="first").reset_index(drop=True)


def compare(spark, con, sf_dir, name, query, sql):
    """An empty text when both agree, else what differs."""
    start = time.time()
    got = query(spark, sf_dir).toArrow()
    SPENT[name] = time.time() - start
    if sql is None:
        return "" if got.num_rows else "no rows"
    want = con.execute(sql).to_arrow_table()
    a, b = arrow_kinds(got), arrow_kinds(want)
    if a != b:
        return f"schema: {sorted(set(a.items()) ^ set(b.items()))}"
    if got.num_rows != want.num_rows:
        return f"rows: {got.num_rows} vs {want.num_rows}"
    x, y = normal(got), normal(want)
    for c in x.columns:
        same = (x[c] == y[c]) | (x[c].isna() & y[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, e.g. {x.loc[i].to_dict()} vs {y.loc[i].to_dict()}"
    return ""


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8, **{"spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = tables(sf)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in only or qs:
        start = time.time()
        try:
            said = compare(spark, con, sf, name, qs[name], sqls.get(name))
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {SPENT.get(name, 0):.1f}s of {time.time() - start:.1f}s {said}", flush=True)
    print(f"{bad} of {len(only or qs)} failed")
