"""Run queries on Spark and their SQL on DuckDB and compare the rows.

Usage: python tests/compare.py [folder] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, connection, sql):
    """Empty text if both sides agree, else what differs."""
    ours = df.collect()
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    left, right = rows_of(df.columns, ours), rows_of(names, theirs)
    if left != right:
        wrong = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(wrong)} rows differ, first {sorted(names)}: {wrong[0]}"
    return ""


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("tierflow-check")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry
    from tierflow.runtime import stored_steps

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = session(), connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            with stored_steps(spark):
                df = queries[name](spark, folder)
                if name in checks:
                    note = compare(df, connection, checks[name]) or "ok"
                    size = ""
                else:
                    note, size = "rows only", df.count()
        except Exception as error:  # report and go on with the next query
            note, size = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += note not in ("ok", "rows only")
        print(f"{name:28} {time.time() - start:6.1f}s {note} {size}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
