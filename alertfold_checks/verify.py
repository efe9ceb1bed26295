"""Run registered queries next to their SQL and compare all rows.

    python -m alertfold_checks.verify [data directory] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from alertfold_checks.inputs import TABLES
from alertfold_checks.oracles import ORACLES
from alertfold_checks.queries import registered


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    frame = registered()[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    start = time.time()
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    note = f"{len(got)} rows, {took:.1f} s, SQL {time.time() - start:.1f} s"
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} and {sorted(columns)}"
    if got != want:
        only = [r for r in got[:200000] if r not in set(want)][:2], [r for r in want[:200000] if r not in set(got)][:2]
        return False, f"{note}; {len(want)} rows wanted; {only}"
    return True, note


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    names = sys.argv[2:] or list(registered())
    failed = 0
    for name in names:
        try:
            good, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the others
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
