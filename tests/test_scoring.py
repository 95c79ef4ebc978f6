"""Scoring views and dashboard datasets on a small history with ties, ERROR rows and odd severities."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scores import score_band
from plumbline.model import RESULTS_SCHEMA, RULES_SCHEMA
from plumbline.operators import reports, scoring

NOW = datetime(2024, 1, 31, 6)


def result(rule_id, status, days_ago=0, severity="HIGH", table="D.S.T", dimension="Validity", pct=0.0, suffix="", hours=0):
    stamp = NOW - timedelta(days=days_ago, hours=hours)
    row = dict(result_id=f"{stamp:%d%H}{suffix}:{rule_id}", run_id=f"{stamp:%d%H}", run_ts=stamp, rule_id=rule_id,
               rule_name=f"rule {rule_id}", table_fqn=table, rule_type="RANGE", dimension=dimension, severity=severity,
               total_rows=100, failed_rows=int(pct), failed_pct=None if status == "ERROR" else pct, threshold_pct=0.0,
               status=status, duration_ms=1500, triggered_by="MANUAL")
    return tuple(row.get(n) for n in RESULTS_SCHEMA.names)


def catalog(spark, *ids, inactive=()):
    rows = [(i, f"rule {i}", f"about {i}", "D", "S", "T", "c", "RANGE", "{}", None, 0.0, "HIGH", "Validity", "team",
             i not in inactive, None, None, None) for i in (*ids, *inactive)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RESULTS_SCHEMA)


def test_latest_breaks_ties_and_drops_inactive_rules(spark):
    results = frame(spark, result(1, "PASS", suffix="a"), result(1, "FAIL", suffix="b"), result(1, "ERROR", 1),
                    result(2, "PASS"), result(3, "PASS"))
    latest = scoring.latest_results(results, catalog(spark, 1, 2, inactive=(3,)))
    assert {r.rule_id: (r.status, r.weight, r.owner) for r in latest.collect()} == {
        1: ("FAIL", 4, "team"), 2: ("PASS", 4, "team")}
    assert [(r.rule_id, r.status) for r in scoring.previous_results(results).collect()] == [(1, "PASS")]


def test_daily_keeps_inactive_rules_and_the_last_run_of_a_day(spark):
    results = frame(spark, result(1, "FAIL", 1, hours=3), result(1, "PASS", 1), result(9, "FAIL", 1))
    daily = scoring.daily_results(results)
    assert {(r.rule_id, r.run_date, r.status) for r in daily.collect()} == {
        (1, date(2024, 1, 30), "PASS"), (9, date(2024, 1, 30), "FAIL")}


def test_scores_weigh_by_severity(spark):
    results = frame(
        spark, result(1, "PASS", severity="CRITICAL"), result(2, "FAIL", severity="MEDIUM"),
        result(3, "ERROR", severity="LOW"), result(4, "FAIL", severity="WEIRD"), result(5, "PASS", severity=None))
    health = scoring.table_health(scoring.latest_results(results, catalog(spark, 1, 2, 3, 4, 5))).first()
    assert (health.checks, health.passed, health.failed, health.errors) == (5, 2, 2, 1)
    assert health.dq_score == 72.7 and health.critical_issues == 0
    unknown = scoring.table_health(scoring.latest_results(frame(spark, result(1, "PASS", severity="?")), catalog(spark, 1)))
    assert unknown.first().dq_score is None


def test_dimension_score_leaves_out_missing_dimensions(spark):
    results = frame(spark, result(1, "PASS"), result(2, "FAIL", dimension=None))
    latest = scoring.latest_results(results, catalog(spark, 1, 2))
    assert [(r.dimension, r.dq_score) for r in scoring.dimension_score(latest).collect()] == [("Validity", 100.0)]
    assert reports.dimension_status(latest).count() == 1


def test_delta_is_against_the_second_newest_day_present(spark):
    results = frame(spark, result(1, "PASS"), result(2, "FAIL"), result(1, "FAIL", 9), result(2, "FAIL", 9),
                    result(1, "PASS", 40))
    latest, daily = scoring.latest_results(results, catalog(spark, 1, 2)), scoring.daily_results(results)
    row = reports.overview_kpis(latest, daily, NOW, 30).first()
    assert (row.dq_score, row.previous_score, row.score_delta, row.passing, row.pass_rate) == (50.0, 0.0, 50.0, 1, 50.0)
    alone = reports.overview_kpis(latest, daily, NOW, 5).first()
    assert alone.previous_score is None and alone.score_delta is None


def test_open_issues_order_and_remainder(spark):
    results = frame(
        spark, result(1, "FAIL", severity="LOW", pct=90.0), result(2, "FAIL", severity="CRITICAL", pct=1.0),
        result(3, "ERROR", severity="CRITICAL"), result(4, "FAIL", severity="CRITICAL", pct=7.0),
        result(5, "FAIL", severity="?", pct=99.0), result(6, "PASS", severity="CRITICAL"))
    latest = scoring.latest_results(results, catalog(spark, *range(1, 7)))
    assert [r.rule_id for r in reports.open_issues(latest).collect()] == [4, 2, 3, 1, 5]
    assert [r.rule_id for r in reports.open_issues(latest, top=2).collect()] == [4, 2]
    assert tuple(reports.open_issue_counts(latest, top=2).first()) == (5, 3)


def test_run_history_counts_everything(spark):
    results = frame(spark, *[result(i, "PASS" if i % 2 else "FAIL", i / 10) for i in range(1, 21)])
    newest = reports.run_history(results, NOW, days=30)
    kpis = reports.run_history_kpis(newest).first()
    assert (kpis.executions, kpis.pass_rate, kpis.failures, kpis.avg_duration_s) == (20, 50.0, 10, 1.5)
    assert [r.rule_id for r in reports.run_history(results, NOW, days=30, limit=3).collect()] == [1, 2, 3]
    assert reports.run_history(results, NOW, statuses=("FAIL",), days=1).count() == 5
    assert reports.run_history_kpis(newest.where("false")).first().pass_rate is None


@pytest.mark.parametrize("score,band", [(95.0, "good"), (94.9, "warn"), (80.0, "warn"), (79.9, "bad"), (None, "muted")])
def test_score_band(spark, score, band):
    row = spark.createDataFrame([(score,)], "s double").select(score_band(F.col("s")).alias("b")).first()
    assert row.b == band


def test_search_is_literal_and_any_case(spark):
    rules = catalog(spark, 1, 2, 10)
    latest = scoring.latest_results(frame(spark, result(1, "PASS")), rules)
    assert [r.rule_id for r in reports.rule_listing(rules, latest, text="RULE 1").collect()] == [1, 10]
    assert reports.rule_listing(rules, latest, text="rule.1").count() == 0


def test_newest_per_rule_is_pruned_before_the_shuffle(spark):
    plan = scoring.previous_results(frame(spark, result(1, "PASS")))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
