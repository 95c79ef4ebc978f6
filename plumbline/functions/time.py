"""Time arithmetic against an explicit clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import timestamp_literal


def boundary_difference_sql(unit: str, later: str, earlier: str) -> str:
    """Minute or hour boundaries crossed between two instants (12:00:59 to 12:01:00 is one minute)."""
    seconds = {"MINUTE": 60, "HOUR": 3600}[unit]

    def floor(moment: str) -> str:
        return f"unix_seconds(date_trunc('{unit}', CAST({moment} AS TIMESTAMP)))"

    return f"(({floor(later)} - {floor(earlier)}) div {seconds})"


def recent(frame: DataFrame, moment: str, as_of: datetime, days: int, partition: str = "run_date") -> DataFrame:
    """Rows of the last ``days`` days. Where the frame carries the partition column of its log, the same
    bound is put on it so that old partitions are never listed."""
    cutoff = as_of - timedelta(days=days)
    frame = frame.where(F.col(moment) >= F.expr(timestamp_literal(cutoff)))
    if partition in frame.columns:
        frame = frame.where(F.col(partition) >= F.lit(cutoff.date()))
    return frame


def recent_dates(frame: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    return frame.where(F.col(column) >= F.lit((as_of - timedelta(days=days)).date()))
