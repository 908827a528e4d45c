"""Run registered queries against their SQL in DuckDB: ``python -m tests.check [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def spark_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def normal(value):
    return str(value) if not isinstance(value, float) else repr(round(value, 9))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, [str(c[1]) for c in cursor.description], cursor.fetchall()


# How Spark types and DuckDB types correspond.
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, sf_dir: str, name: str) -> str:
    """Empty when equal, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    names, types, want = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {n: SAME_TYPE.get(t, t.upper()) for n, t in df.dtypes}
    odd = [(n, spark_types[n], t) for n, t in zip(names, types) if spark_types[n] != t]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)} {x} != {y}"
    if not a:
        return "empty"
    return f"types {odd}" if odd else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            result = compare(spark, sf_dir, name)
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if not result else 'FAIL'} {name} {time.time() - start:.1f}s {result[:900]}", flush=True)
