"""Run registered queries beside their SQL and compare rows, names and values.

``python tests/compare.py <sf_dir> [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = [tuple(None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in row)
             for row in frame.astype(object).itertuples(index=False)]
    return sorted(plain, key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    kinds = {c: (spark_frame[c].dtype.kind, sql_frame[c].dtype.kind) for c in spark_frame.columns}
    mixed = {c: k for c, k in kinds.items() if len(spark_frame) and k[0] != k[1] and not ("f" in k and set(k) & set("if"))}
    left, right = rows(spark_frame), rows(sql_frame)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)} {mixed or ''}"
    for a, b in zip(left, right):
        if a != b:
            return f"{str(a)[:700]}\n   / {str(b)[:700]} {mixed or ''}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = database(sf_dir), registered.oracle_sql()
    for name, query in registered.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            left = query(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"rows {name} {len(left)} {took:.1f}s", flush=True)
                continue
            right = con.sql(oracle[name]).df()
            wrong = difference(left, right)
            print(f"{'FAIL' if wrong else 'ok  '} {name} {len(left)} {took:.1f}s {wrong or ''}", flush=True)
        except Exception as e:  # noqa: BLE001 - every query is reported
            print(f"ERR  {name} {type(e).__name__} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
