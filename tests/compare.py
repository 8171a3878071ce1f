"""Runs registered queries and their DuckDB SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def mismatch(spark, db, query, sql, sf_dir):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    got = db.execute(sql)
    b = rows([x[0] for x in got.description], got.fetchall())
    if a == b:
        return None
    return f"{a[0]} {b[0]}, {len(a[1])} and {len(b[1])} rows; {next(((x, y) for x, y in zip(a[1], b[1]) if x != y), '')}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, q = connect(sys.argv[1]), entry.queries()
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) == 2 or name in sys.argv[2:]:
            t = time.time()
            try:
                said = mismatch(spark, db, q[name], sql, sys.argv[1])
            except Exception as e:
                said = f"{type(e).__name__}: {str(e)[:300]}"
            print(name, round(time.time() - t, 1), said or "ok", flush=True)
