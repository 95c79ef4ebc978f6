"""Metric measurements: a long time series per (table, metric, arguments)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.text import grouping_key, quote, timestamp_literal
from plumbline.functions.time import boundary_difference_sql, recent
from plumbline.model import MEASUREMENTS_SCHEMA

SERIES = ("table_fqn", "metric", "arguments")


def measure_table(
    frame: DataFrame, table_fqn: str, *, as_of: datetime, null_count: Sequence[str] = (),
    duplicate_count: Sequence[Sequence[str] | str] = (), freshness: Sequence[str] = (),
) -> DataFrame:
    """ROW_COUNT, NULL_COUNT per column, FRESHNESS per column (minutes since the newest value) in
    one aggregate, and DUPLICATE_COUNT per key (rows beyond the first of each key)."""
    clock = timestamp_literal(as_of)

    def row(metric: str, arguments: str | None, value) -> object:
        return F.struct(F.lit(metric).alias("metric"), F.lit(arguments).cast("string").alias("arguments"),
                        value.cast("double").alias("value"))

    values = [row("ROW_COUNT", None, F.count(F.lit(1)))]
    values += [row("NULL_COUNT", c, F.count_if(F.col(quote(c)).isNull())) for c in null_count]
    values += [row("FRESHNESS", c, F.expr(boundary_difference_sql("MINUTE", clock, f"max({quote(c)})")))
               for c in freshness]
    measured = frame.agg(F.array(*values).alias("m")).select(F.inline("m"))
    for key in duplicate_count:
        columns = [key] if isinstance(key, str) else list(key)
        groups = frame.groupBy(*[grouping_key(frame, quote(c)) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
        beyond_first = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value"))
        measured = measured.unionByName(beyond_first.select(
            F.lit("DUPLICATE_COUNT").alias("metric"), F.lit(", ".join(columns)).alias("arguments"), "value"))
    return measured.select(
        F.expr(clock).alias("measured_at"), F.lit(table_fqn).alias("table_fqn"), "metric", "arguments", "value",
    ).select(*MEASUREMENTS_SCHEMA.names)


def newest_measurements(measurements: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """All measurements of the window; over a store only its days are read."""
    return recent(measurements, "measured_at", as_of, days, "measured_date")


def latest_metrics(newest: DataFrame) -> DataFrame:
    """Newest value per series; a missing argument list is a series of its own."""
    order = Window.partitionBy(*SERIES).orderBy(F.col("measured_at").desc(), F.col("value").desc())
    return newest.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") == 1).drop("__rn")


def metric_series(newest: DataFrame, table_fqn: str, metric: str, arguments: str | None = None) -> DataFrame:
    same = (F.col("table_fqn") == table_fqn) & (F.col("metric") == metric)
    return newest.where(same & (F.coalesce("arguments", F.lit("")) == (arguments or ""))).select(
        "measured_at", "value").orderBy("measured_at")


def series_like(newest: DataFrame, chosen: DataFrame) -> DataFrame:
    """The measurements of the chosen (table, metric, arguments) rows."""
    same = F.lit(True)
    for column in SERIES:
        same = same & newest[column].eqNullSafe(chosen[column])
    return newest.join(chosen, same, "left_semi")


def metric_kpis(newest: DataFrame) -> DataFrame:
    """Tables, distinct series and measurements. Series are counted per distinct triple first, so
    a series with most of the measurements is one row after the partial aggregation."""
    per_series = newest.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    return per_series.agg(
        F.count_distinct("table_fqn").alias("tables"),
        F.count(F.lit(1)).alias("metrics"),
        F.sum("n").alias("measurements"),
    )
