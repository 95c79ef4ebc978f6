"""Run registered queries beside their SQL and report differences.

    python -m workload.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workload.base import TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("plumbline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(float(f"{value:.12g}"))
    if isinstance(value, decimal.Decimal):
        return repr(float(f"{float(value):.12g}"))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows(columns, records) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


def differences(spark_frame, connection, sql: str) -> list[str]:
    got = rows(spark_frame.columns, spark_frame.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(spark_frame.columns) != sorted(names):
        return [f"columns {sorted(spark_frame.columns)} against {sorted(names)}"]
    if got == want:
        return []
    only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return [f"{len(got)} rows against {len(want)}", *[f"  spark  {r}" for r in only_got], *[f"  sql    {r}" for r in only_want]]


SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp", "FLOAT": "float", "VARCHAR[]": "array<string>",
}


def type_differences(spark_frame, connection, sql: str) -> list[str]:
    described = {r[0]: r[1] for r in connection.execute(f"DESCRIBE ({sql})").fetchall()}
    found = []
    for name, kind in spark_frame.dtypes:
        want = described.get(name, "").replace("DECIMAL", "decimal")
        if SPARK_TYPES.get(want, want) != kind.removesuffix("_ntz"):
            found.append(f"type of {name}: {kind} against {want}")
    return found


def main() -> int:
    from workload import ORACLE, QUERIES

    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    spark, connection, bad = session(), database(sf_dir), 0
    for name in arguments or QUERIES:
        started = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                found = differences(frame, connection, ORACLE[name])
                note = f"{frame.count()} rows" if not found else "DIFFERENT"
                found += type_differences(frame, connection, ORACLE[name])
            else:
                found, note = [], f"rows only: {frame.count()}"
        except Exception as problem:  # noqa: BLE001
            found, note = [f"{type(problem).__name__}: {str(problem)[:1500]}"], "BROKEN"
        bad += bool(found)
        print(f"{name:30s} {time.time() - started:6.2f}s  {note}", *found, sep="\n  " if found else "  ", flush=True)
    print(f"{bad} of {len(arguments or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
