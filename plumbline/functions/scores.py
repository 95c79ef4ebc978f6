"""Severity ranks and weights, the weighted score and its band."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from plumbline.model import SEVERITIES, SEVERITY_WEIGHTS

# Score bands.
GOOD_FROM = 95
WARN_FROM = 80


def _lookup(key: Column, values: Mapping[str, int]) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(key == name, F.lit(value))
    return chain  # NULL for any other key


def severity_weight(severity: Column, weights: Mapping[str, int] = SEVERITY_WEIGHTS) -> Column:
    return _lookup(severity, weights)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {name: rank for rank, name in enumerate(SEVERITIES)})


def weighted_score() -> Column:
    """Share of the weight held by passing checks, 0 to 100. Checks of unknown severity carry no
    weight and ERROR counts as not passing."""
    passed = F.sum(F.when(F.col("status") == "PASS", F.col("weight")).otherwise(0))
    return F.round(100 * passed / F.nullif(F.sum("weight"), F.lit(0)), 1)


def status_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
    ]


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "muted")
        .when(score >= GOOD_FROM, "good")
        .when(score >= WARN_FROM, "warn")
        .otherwise("bad")
    )
