"""Runs registered queries in Spark and their checks in DuckDB, and compares whole results."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if type(value).__name__ in ("float32", "float64"):
        return plain(float(value))
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in frame_rows)


def spark_rows(df):
    return rows_of([tuple(r) for r in df.collect()], df.columns)


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return rows_of(cur.fetchall(), columns)


def session(**conf):
    from rowflow.session import build_session

    return build_session(
        "rowflow-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            **conf,
        },
    )


def main(argv):
    """python tests/harness.py FOLDER [PREFIX ...]: check queries by name prefix."""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    folder, prefixes = argv[0], tuple(argv[1:]) or ("",)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            cols, got = spark_rows(fn(spark, folder))
        except Exception as ex:
            bad.append(name)
            print(f"FAIL {name}: {str(ex)[:1500]}")
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name} {sum(got.values())} {took:.2f}s")
            continue
        try:
            start = time.time()
            want_cols, want = duck_rows(con, oracles[name])
            duck = time.time() - start
        except Exception as ex:
            bad.append(name)
            print(f"SQL  {name}: {str(ex)[:800]}")
            continue
        if cols == want_cols and got == want:
            note = "" if sum(got.values()) else "  (EMPTY)"
            print(f"ok   {name} {sum(got.values())} spark {took:.2f}s duck {duck:.2f}s{note}")
        else:
            bad.append(name)
            print(f"DIFF {name} cols {cols} / {want_cols}; rows {sum(got.values())} / {sum(want.values())}")
            print("   only spark:", list((got - want).items())[:3])
            print("   only duck: ", list((want - got).items())[:3])
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
