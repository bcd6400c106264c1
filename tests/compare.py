"""Compare every query with its SQL: ``python tests/compare.py SF_DIR [query ...]``."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as driver  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, con, sf_dir, name, sql):
    """None when query and SQL agree, else a short description."""
    df = driver.queries()[name](spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    if found == expected:
        return None
    pairs = [p for p in zip(found[1], expected[1]) if p[0] != p[1]][:2]
    return f"{found[0]} {expected[0]} rows {len(found[1])} / {len(expected[1])}: {str(pairs)[:1500]}"


def session():
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


if __name__ == "__main__":
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sys.argv[1])
    for name, sql in driver.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            result = difference(spark, con, sys.argv[1], name, sql)
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {'ok' if result is None else result} ({time.time() - start:.1f}s)", flush=True)
