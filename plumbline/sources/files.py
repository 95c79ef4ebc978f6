"""What is known of a table's files without reading their data."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Types whose bounds a Parquet footer holds as exact values.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)

COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def listing(frame: DataFrame, path: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the files behind a frame, listed and read by tasks: no content is read, and the
    driver asks no file system about a single file. ``path``: the folder whose files they all are."""
    reader = frame.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(path if path else [unquote(f) for f in frame.inputFiles()])
    return files.select("path", "length", "modificationTime", "_metadata")


def footer_statistics(spark: SparkSession, path: str, columns: Sequence[T.StructField]) -> dict:
    """``rows``, and per column (non-null count, smallest, greatest) of a Parquet table, by an aggregate that
    Spark pushes down to the files' footers. Bounds are given for integers, dates and booleans, and no counts for
    complex columns.

    Footers are read by tasks; no column is. The push-down is a setting of a session, so a session of its own is
    used. Where a footer lacks statistics, the columns are read after all."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for k, field in enumerate(columns):
        name = f"`{field.name.replace('`', '``')}`"
        if not isinstance(field.dataType, COMPLEX):
            aggregates.append(F.count(F.col(name)).alias(f"n{k}"))
        if isinstance(field.dataType, BOUNDED):
            aggregates += [F.min(F.col(name)).alias(f"low{k}"), F.max(F.col(name)).alias(f"high{k}")]
    try:
        row = footers(spark, path).agg(*aggregates).first()
    except Exception:  # noqa: BLE001 - the footers do not have them all
        row = spark.read.parquet(path).agg(*aggregates).first()
    found = {k: v or 0 if k == "rows" or k.startswith("n") else v for k, v in row.asDict().items()}     # no files: no counts
    return {"rows": found["rows"], "columns": {
        field.name: (found.get(f"n{k}"), found.get(f"low{k}"), found.get(f"high{k}")) for k, field in enumerate(columns)}}


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The table in a session in which aggregates over it are answered from footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)
