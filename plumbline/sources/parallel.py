"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

CONCURRENT_JOBS = 8

In, Out = TypeVar("In"), TypeVar("Out")


def side_by_side(spark: SparkSession, work: Callable[[In], Out], items: Iterable[In],
                 jobs: int = CONCURRENT_JOBS) -> list[Out]:
    """Apply ``work`` to every item, a few at a time, in threads that keep the caller's job group
    and scheduler pool. Spark shares the executors between their jobs."""
    with ThreadPoolExecutor(max_workers=jobs) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
