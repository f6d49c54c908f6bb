"""Run registered queries against their SQL in DuckDB.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    return str(value) if not isinstance(value, (int, str)) else value


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in frame.columns}


def rows(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if a != b:
        only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"{len(spark_frame)} vs {len(sql_frame)} rows; spark only {only_a!r:.900}; sql only {only_b!r:.900}"
    ka, kb = kinds(spark_frame), kinds(sql_frame)
    # A column with nulls has no integer kind on one side.
    differ = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and not spark_frame[c].isna().any()}
    if len(spark_frame) and differ:
        return f"types {differ}"
    return None


def main() -> int:
    from stellwerk.catalog import build
    from stellwerk.session import build_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    options = args.parse_args()
    spark = build_session(
        "compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog, con, bad = build(), duck(options.sf), 0
    for name in options.names or catalog.queries:
        start = time.time()
        try:
            got = catalog.queries[name](spark, options.sf).toPandas()
            spent = time.time() - start
            if name in catalog.sql:
                start = time.time()
                problem = compare(got, con.execute(catalog.sql[name]).df())
                sql_spent = time.time() - start
            else:
                problem, sql_spent = None, 0.0
            status = "ok" if problem is None else "DIFF"
            mark = "" if name in catalog.sql else " (no sql)"
            print(f"{status:5} {name:28} {len(got):7} rows {spent:6.2f}s sql {sql_spent:6.2f}s{mark}", flush=True)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {e}"[:1500]
            print(f"FAIL  {name}", flush=True)
        if problem:
            bad += 1
            print("      " + problem, flush=True)
    print(f"{bad} of {len(options.names or catalog.queries)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
