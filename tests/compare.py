"""Run queries on Spark and their SQL on DuckDB, and compare names, counts and values.

``python tests/compare.py [sf] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TESTDATA = "/root/testdata"


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meibo")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(f"{TESTDATA}/sf{sf}")):
        path = f"{TESTDATA}/sf{sf}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def difference(got: DataFrame, con: duckdb.DuckDBPyConnection, text: str) -> str:
    """Empty when both results agree, else what differs."""
    want = con.sql(text)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {names} / {sorted(want.columns)}"
    left = Counter(map(tuple, got.select(*[f"`{n}`" for n in names]).collect()))
    quoted = ", ".join(f'"{n}"' for n in names)
    right = Counter(want.query("w", f"select {quoted} from w").fetchall())
    if left != right:
        only = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"{left.total()} / {right.total()} rows; only Spark {only[0]}; only DuckDB {only[1]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, con = session(), connect(sf)
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            bad = difference(fn(spark, f"{TESTDATA}/sf{sf}"), con, oracle[name])
        except Exception as error:  # noqa: BLE001
            bad = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok ' if not bad else 'BAD'} {name} {time.time() - start:.1f}s {bad}", flush=True)
