"""Views over the result history: latest, daily and previous results, scores and trends.

"The newest per rule" is a row number limited to one, which Spark prunes inside each input
partition before the shuffle (WindowGroupLimit): a rule that owns a third of the history sends a
single row per input partition, not its rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.functions.scores import severity_weight, status_counts, weighted_score
from plumbline.functions.time import recent_dates
from plumbline.model import SEVERITY_WEIGHTS

ROLLUP_SCHEMA = T.StructType([
    T.StructField("run_date", T.DateType()),
    T.StructField("table_fqn", T.StringType()),
    T.StructField("dimension", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("checks", T.LongType()),
])


def _nth_newest(results: DataFrame, keys: list[str], n: int) -> DataFrame:
    newest_first = Window.partitionBy(*keys).orderBy(F.col("run_ts").desc(), F.col("result_id").desc())
    return results.withColumn("__rn", F.row_number().over(newest_first)).where(F.col("__rn") == n).drop("__rn")


def with_weight(results: DataFrame, weights: Mapping[str, int] = SEVERITY_WEIGHTS) -> DataFrame:
    return results.withColumn("weight", severity_weight(F.col("severity"), weights))


def latest_results(results: DataFrame, rules: DataFrame, weights: Mapping[str, int] = SEVERITY_WEIGHTS) -> DataFrame:
    """Most recent result of every active rule, with weight, owner and description."""
    active = rules.where(F.col("is_active")).select("rule_id", "owner", "description")
    return with_weight(_nth_newest(results, ["rule_id"], 1), weights).join(active, "rule_id")


def previous_results(results: DataFrame) -> DataFrame:
    """The result before the latest one, per rule (inactive rules and backfilled rows included)."""
    return _nth_newest(results, ["rule_id"], 2)


def daily_results(results: DataFrame, weights: Mapping[str, int] = SEVERITY_WEIGHTS) -> DataFrame:
    """Last result per rule and day. Filters on ``run_date`` are pushed below the window."""
    dated = results if "run_date" in results.columns else results.withColumn("run_date", F.to_date("run_ts"))
    return with_weight(_nth_newest(dated, ["rule_id", "run_date"], 1), weights)


def daily_table_score(daily: DataFrame) -> DataFrame:
    return daily.groupBy("run_date", "table_fqn").agg(*status_counts(), weighted_score().alias("dq_score"))


def table_health(latest: DataFrame) -> DataFrame:
    critical = (F.col("status") != "PASS") & (F.col("severity") == "CRITICAL")
    return latest.groupBy("table_fqn").agg(
        *status_counts(),
        F.count_if(critical).alias("critical_issues"),
        weighted_score().alias("dq_score"),
        F.max("run_ts").alias("last_run_ts"),
    )


def score_trend(daily: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Overall score, checks and issues per day of the window."""
    return recent_dates(daily, "run_date", as_of, days).groupBy("run_date").agg(
        weighted_score().alias("dq_score"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") != "PASS").alias("issues"),
    )


def daily_rollup(results: DataFrame) -> DataFrame:
    """Checks per day, table, dimension, severity and status, a rule counting with its last result of the day."""
    groups = ROLLUP_SCHEMA.names[:-1]
    return daily_results(results).groupBy(*groups).agg(F.count(F.lit(1)).alias("checks")).select(*ROLLUP_SCHEMA.names)


def _rolled(rollup: DataFrame, *keys: str, weights: Mapping[str, int] = SEVERITY_WEIGHTS):
    weight = severity_weight(F.col("severity"), weights) * F.col("checks")
    passed = F.sum(F.when(F.col("status") == "PASS", weight).otherwise(0))
    counts = {name: F.sum(F.when(F.col("status") == status, F.col("checks")).otherwise(0)) for name, status in (
        ("passed", "PASS"), ("failed", "FAIL"), ("errors", "ERROR"))}
    return rollup.groupBy(*keys).agg(
        F.sum("checks").alias("checks"), *[total.alias(name) for name, total in counts.items()],
        F.round(100 * passed / F.nullif(F.sum(weight), F.lit(0)), 1).alias("dq_score"),
        F.sum(F.when(F.col("status") == "PASS", F.lit(0)).otherwise(F.col("checks"))).alias("issues"))


def rolled_table_score(rollup: DataFrame) -> DataFrame:
    """``daily_table_score`` out of a roll-up: one row per group is read instead of the results."""
    return _rolled(rollup, "run_date", "table_fqn").drop("issues")


def rolled_score_trend(rollup: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """``score_trend`` out of a roll-up."""
    return _rolled(recent_dates(rollup, "run_date", as_of, days), "run_date").select("run_date", "dq_score", "checks", "issues")


def rolled_heat_map(rollup: DataFrame) -> DataFrame:
    """Checks per day, dimension and status."""
    return rollup.groupBy("run_date", "dimension", "status").agg(F.sum("checks").alias("n"))


def dimension_score(latest: DataFrame) -> DataFrame:
    """Score per quality dimension; results without a dimension are left out."""
    return latest.where(F.col("dimension").isNotNull()).groupBy("dimension").agg(
        F.count("rule_id").alias("checks"), weighted_score().alias("dq_score"))
