"""Compare named queries with their SQL twins. Run as a script: compare.py FOLDER [NAME...]."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if pd.isna(value):
            return ""
        if isinstance(value, float):
            return str(int(value)) if value.is_integer() else f"{value:.9g}"
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False))


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    for left, right in zip(a, b, strict=True):
        if left != right:
            return f"{left} != {right}"
    return None


def types_differ(mine, theirs: list[tuple[str, str]]) -> str | None:
    """Spark types next to DuckDB's."""
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
    }
    other = dict(theirs)
    bad = {n: (t, other.get(n)) for n, t in mine if same.get(t) != other.get(n)}
    return f"types {bad}" if bad else None


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = oracle_sql()
    failed = []
    for name, build in queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            frame = build(spark, folder)
            mine = frame.toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"{name:26} rows {len(mine):7}  {took:6.2f}s  no SQL", flush=True)
                continue
            start = time.time()
            found = con.execute(oracles[name])
            shape = [(d[0], str(d[1])) for d in found.description]
            theirs = found.df()
            sql_took = time.time() - start
            wrong = differences(mine, theirs) or types_differ(frame.dtypes, shape)
            print(
                f"{name:26} rows {len(mine):7}  {took:6.2f}s  sql {sql_took:6.2f}s  {wrong or 'ok'}",
                flush=True,
            )
        except Exception as error:
            wrong = str(error)[:600]
            print(f"{name:26} FAILED {wrong}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if wrong:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
