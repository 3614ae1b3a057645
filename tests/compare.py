"""Runs queries beside their DuckDB statements and reports where rows differ: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(x):
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> str:
    """Empty if equal."""
    df = build(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} against {columns}"
    want = rows(columns, found.fetchall())
    if got == want:
        return "" if got else "both empty"
    more = [r for r in got if r not in set(want)][:2]
    less = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; only here {str(more)[:300]}; only there {str(less)[:300]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]
    bad = 0
    for name in names:
        try:
            said = compare(spark, con, sys.argv[1], name, queries[name], oracle.get(name))
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        if said:
            bad += 1
            print("BAD", name, said, flush=True)
    print(len(names), "queries,", bad, "differ")
