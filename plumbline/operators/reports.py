"""Dashboard datasets over the history and the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scores import score_band, severity_rank, weighted_score
from plumbline.functions.time import recent, recent_dates
from plumbline.operators.scoring import daily_results, daily_table_score, latest_results, score_trend, table_health

OPEN_ISSUES = 12
DETAIL_DAYS = 90


# -- overview -----------------------------------------------------------------------------------


def overview_kpis(latest: DataFrame, daily: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """One row: score, checks by outcome, critical issues, tables, last run, change against the
    second-newest day present in the window."""
    today = latest.agg(
        weighted_score().alias("dq_score"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "FAIL").alias("failing"),
        F.count_if(F.col("status") == "ERROR").alias("errored"),
        F.count_if((F.col("status") != "PASS") & (F.col("severity") == "CRITICAL")).alias("critical_issues"),
        F.count_distinct("table_fqn").alias("tables_monitored"),
        F.max("run_ts").alias("last_run_ts"),
    )
    two_days = score_trend(daily, as_of, days).orderBy(F.col("run_date").desc()).limit(2)
    before = two_days.agg(F.when(F.count(F.lit(1)) > 1, F.min_by("dq_score", "run_date")))
    passing = F.col("checks") - F.col("failing") - F.col("errored")
    return today.withColumn("previous_score", before.scalar()).select(
        "*",
        passing.alias("passing"),
        F.round(100 * passing / F.nullif(F.col("checks"), F.lit(0)), 0).alias("pass_rate"),
        F.round(F.col("dq_score") - F.col("previous_score"), 1).alias("score_delta"),
        score_band(F.col("dq_score")).alias("band"),
    )


def status_mix(latest: DataFrame) -> DataFrame:
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def leaderboard(health: DataFrame) -> DataFrame:
    """Tables from worst to best score, most critical issues first among equals."""
    return health.select(
        "table_fqn", "dq_score", score_band(F.col("dq_score")).alias("band"), "checks", "failed", "errors",
        "critical_issues", "last_run_ts",
    ).orderBy(F.col("dq_score").asc_nulls_last(), F.col("critical_issues").desc(), "table_fqn")


def score_heatmap(daily: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    scores = daily_table_score(recent_dates(daily, "run_date", as_of, days))
    return scores.select("run_date", "table_fqn", "dq_score", "checks", "failed")


def _issue_order() -> list[Column]:
    return [F.col("severity_rank").asc_nulls_last(), F.col("failed_pct").desc_nulls_last(), F.col("rule_id").asc()]


def open_issues(latest: DataFrame, top: int = OPEN_ISSUES) -> DataFrame:
    """The most severe issues: severity first, then the share of failing rows."""
    issues = latest.where(F.col("status") != "PASS").withColumn("severity_rank", severity_rank(F.col("severity")))
    return issues.orderBy(*_issue_order()).limit(top).select(
        "rule_id", "rule_name", "table_fqn", "column_name", "rule_type", "severity", "severity_rank", "status",
        "failed_rows", "failed_pct", "threshold_pct", "error_message",
    )


def open_issue_counts(latest: DataFrame, top: int = OPEN_ISSUES) -> DataFrame:
    total = F.count_if(F.col("status") != "PASS")
    return latest.agg(total.alias("open_issues"), F.greatest(total - top, F.lit(0)).alias("not_shown"))


# -- one table ----------------------------------------------------------------------------------


def table_header(health: DataFrame, table_fqn: str) -> DataFrame:
    chosen = health.where(F.col("table_fqn") == table_fqn)
    return chosen.withColumn("band", score_band(F.col("dq_score")))


def table_trend(daily: DataFrame, table_fqn: str, as_of: datetime, days: int = DETAIL_DAYS) -> DataFrame:
    scores = daily_table_score(recent_dates(daily.where(F.col("table_fqn") == table_fqn), "run_date", as_of, days))
    return scores.select("run_date", "dq_score").orderBy("run_date")


def table_checks(latest: DataFrame, table_fqn: str) -> DataFrame:
    return latest.where(F.col("table_fqn") == table_fqn).select(
        "rule_id", "status", "severity", "rule_name", "column_name", "rule_type", "dimension",
        "failed_rows", "total_rows", "failed_pct", "threshold_pct", "owner",
    ).orderBy("rule_id")


def dimension_status(latest: DataFrame, table_fqn: str | None = None) -> DataFrame:
    rows = latest if table_fqn is None else latest.where(F.col("table_fqn") == table_fqn)
    return rows.where(F.col("dimension").isNotNull()).groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("n"))


def rule_failure_history(daily: DataFrame, as_of: datetime, rule_id: int | None = None,
                         days: int = DETAIL_DAYS) -> DataFrame:
    """Failure rate per day of one rule, or of every rule."""
    rows = daily if rule_id is None else daily.where(F.col("rule_id") == rule_id)
    return recent_dates(rows, "run_date", as_of, days).select(
        "rule_id", "run_date", "failed_pct", "threshold_pct", "status", "failed_rows")


# -- run history --------------------------------------------------------------------------------


def run_history(
    results: DataFrame, as_of: datetime, *, days: int = 30, tables: Sequence[str] = (),
    statuses: Sequence[str] = (), severities: Sequence[str] = (), triggers: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """The executions of the window that match all given filters (an empty filter matches everything). A
    listing may ask for the newest ``limit`` of them; figures and exports take all."""
    rows = recent(results, "run_ts", as_of, days)
    for column, wanted in (("table_fqn", tables), ("status", statuses), ("severity", severities),
                           ("triggered_by", triggers)):
        if wanted:
            rows = rows.where(F.col(column).isin(list(wanted)))
    if limit is None:
        return rows
    return rows.orderBy(F.col("run_ts").desc(), F.col("result_id").desc()).limit(limit)


def run_history_kpis(history: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("status") == "PASS")
    return history.agg(
        F.count(F.lit(1)).alias("executions"),
        F.count_distinct("run_id").alias("runs"),
        F.round(100 * passed / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("pass_rate"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.round(F.avg("duration_ms") / 1000, 2).alias("avg_duration_s"),
    )


def executions_per_day(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("run_ts").alias("run_date"), "status").agg(F.count(F.lit(1)).alias("n"))


HISTORY_EXPORT_DROPS = ("check_sql", "sample_sql", "error_message", "run_id", "run_date")


def history_export(history: DataFrame) -> DataFrame:
    return history.drop(*HISTORY_EXPORT_DROPS)


# -- catalog ------------------------------------------------------------------------------------


def _fqn() -> Column:
    return F.concat_ws(".", "database_name", "schema_name", "table_name")


def rule_listing(rules: DataFrame, latest: DataFrame, *, tables: Sequence[str] = (), types: Sequence[str] = (),
                 text: str | None = None) -> DataFrame:
    """Catalog rows with their last status, filtered and searched. Inactive rules have no status."""
    rows = rules.withColumn("table_fqn", _fqn())
    if tables:
        rows = rows.where(F.col("table_fqn").isin(list(tables)))
    if types:
        rows = rows.where(F.col("rule_type").isin(list(types)))
    if text:
        rows = rows.where(search_text("rule_name", "column_name", "owner", "description").contains(text.lower()))
    last = latest.select("rule_id", F.col("status").alias("last_status"))
    return rows.join(last, "rule_id", "left").select(
        "rule_id", "is_active", "last_status", "rule_name", "table_fqn", "column_name", "rule_type", "rule_params",
        "row_filter", "threshold_pct", "severity", "dimension", "owner",
    ).orderBy("table_fqn", "rule_id")


def search_text(*columns: str) -> Column:
    """Lower-cased text of several columns, NULL as empty, for literal substring search."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def catalog_kpis(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if("is_active").alias("active"),
        F.count_distinct(_fqn()).alias("tables_covered"),
        F.count_distinct("rule_type").alias("rule_types_used"),
        F.count_distinct("owner").alias("owners"),
    )


def rule_coverage(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """Active rules, distinct covered columns and the covered share per table, by full name (in any case)."""
    widths = columns.groupBy("table_fqn", "table_name").agg(F.count(F.lit(1)).alias("n_cols"))
    covered = rules.where(F.col("is_active")).groupBy(F.upper(_fqn()).alias("__fqn")).agg(
        F.count(F.lit(1)).alias("rule_count"),
        F.count_distinct(F.upper("column_name")).alias("covered_cols"),
    )
    share = 100 * F.coalesce("covered_cols", F.lit(0)) / F.nullif(F.col("n_cols"), F.lit(0))
    return widths.join(covered, F.upper("table_fqn") == F.col("__fqn"), "left").select(
        "table_fqn", "table_name", F.coalesce("rule_count", F.lit(0)).alias("rule_count"), "n_cols",
        F.coalesce("covered_cols", F.lit(0)).alias("covered_cols"), F.round(share, 0).alias("coverage_pct"),
    )


def in_schema(rows: DataFrame, database: str, schema: str) -> DataFrame:
    """The rows whose ``table_fqn`` lies in one schema, in any case."""
    return rows.where(F.startswith(F.upper("table_fqn"), F.lit(f"{database}.{schema}.".upper())))


def schema_overview(tables: DataFrame, columns: DataFrame, row_counts: DataFrame, rules: DataFrame,
                    health: DataFrame, database: str, schema: str, sizes: DataFrame | None = None) -> DataFrame:
    """Every table of a schema with size, coverage and score; the least covered come first."""
    of_schema = (F.upper("database_name") == database.upper()) & (F.upper("schema_name") == schema.upper())
    cover = rule_coverage(rules.where(of_schema), in_schema(columns, database, schema)).drop("covered_cols", "table_name")
    scores = in_schema(health, database, schema).select(F.upper("table_fqn").alias("__fqn"), "dq_score")
    listed = in_schema(tables, database, schema).where(F.col("table_type").isin("BASE TABLE", "VIEW", "DYNAMIC TABLE"))
    rows = (
        listed.join(in_schema(row_counts, database, schema).select("table_fqn", "row_count"), "table_fqn", "left")
        .join(cover, "table_fqn", "left")
        .join(scores, F.upper("table_fqn") == F.col("__fqn"), "left").drop("__fqn")
    )
    shown = ["table_name", "table_type", "row_count", "rule_count", "n_cols", "coverage_pct", "dq_score"]
    if sizes is not None:
        rows = rows.join(sizes.select("table_fqn", F.round(F.col("bytes") / 1024 / 1024, 1).alias("size_mb"),
                                      "last_altered"), "table_fqn", "left")
        shown += ["size_mb", "last_altered"]
    return rows.select(*shown).orderBy(
        F.col("coverage_pct").asc_nulls_first(), F.col("row_count").desc_nulls_last(), "table_name")


def existing_rules(rules: DataFrame, latest: DataFrame, database: str, schema: str,
                   active_only: bool = False) -> DataFrame:
    """Rules of one schema with their last result."""
    rows = rules.where((F.col("database_name") == database) & (F.col("schema_name") == schema))
    if active_only:
        rows = rows.where(F.col("is_active"))
    last = latest.select("rule_id", F.col("status").alias("last_status"), "failed_pct", "run_ts")
    return rows.join(last, "rule_id", "left").select(
        "rule_id", "table_name", "rule_name", "column_name", "rule_type", "severity", "is_active", "last_status",
        "failed_pct", "run_ts",
    ).orderBy("table_name", "rule_id")


def result_tables(results: DataFrame) -> DataFrame:
    """The tables that have results, in order: the choices of a history filter."""
    return results.select("table_fqn").distinct().orderBy("table_fqn")


def schema_choices(rules: DataFrame) -> DataFrame:
    """The databases and schemas that have rules, in order."""
    return rules.select("database_name", "schema_name").distinct().orderBy("database_name", "schema_name")


def views(results: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """The scoring views by name, ready for ``createOrReplaceTempView``."""
    latest, daily = latest_results(results, rules), daily_results(results)
    return {
        "v_latest_results": latest,
        "v_daily_results": daily,
        "v_daily_table_score": daily_table_score(daily),
        "v_table_health": table_health(latest),
    }
