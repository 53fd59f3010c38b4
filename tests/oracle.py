"""Run a query on Spark and its SQL on DuckDB and compare the rows.

``python tests/oracle.py [sf] [name ...]`` checks from the command line.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("epipanel-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def _spark_types(df):
    return {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in df.schema.fields}


_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "FLOAT": "float", "SMALLINT": "smallint"}


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a text that says where they differ."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    compare.spark = time.time() - t0
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {c: _TYPE.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    if types != _spark_types(df):
        return f"types {_spark_types(df)} != {types}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, such as {bad[0]} ({sorted(df.columns)})"
    return None


if __name__ == "__main__":
    from epipanel.plans import queries as _q  # noqa: F401
    from epipanel.plans.catalog import ORACLE, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = spark_session(), connect(sf_dir)
    failed = []
    for name in names:
        t0 = time.time()
        try:
            if name in ORACLE:
                message = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
                print(f"   spark {compare.spark:.1f}s", end=" ")
                kind = "ok"
            else:
                message, kind = None, f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        if message:
            failed.append(name)
        print(f"{name}: {message or kind} ({time.time() - t0:.1f}s)", flush=True)
    print("FAILED", failed)
