"""Alert evaluation, notification history, policies and metrics."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import in_scope
from plumbline.model import ALERT_HISTORY_SCHEMA, ALERT_POLICIES_SCHEMA, MEASUREMENTS_SCHEMA, SETTINGS_SCHEMA
from plumbline.operators import alerts, metrics
from tests.test_scoring import NOW, catalog, frame, result


def policies(spark, *rows):
    full = []
    for number, row in enumerate(rows, start=1):
        base = dict(alert_id=number, alert_name=f"p{number}", channel_type="EMAIL", recipients="a@b.c", is_enabled=True)
        full.append(tuple({**base, **row}.get(n) for n in ALERT_POLICIES_SCHEMA.names))
    return alerts.select_policies(spark.createDataFrame(full, ALERT_POLICIES_SCHEMA))


def evaluate(spark, results, rules, *rows, **options):
    evaluated = alerts.evaluate_alerts(spark, results, rules, policies(spark, *rows), NOW, **options)
    return {r.alert_id: r for r in evaluated.collect()}


@pytest.mark.parametrize("scope,fqn,inside", [
    (None, "A.B.C", True), (" , ", "A.B.C", True), ("a.b.c", "A.B.C", True), ("A.*", "A.B.C", True), ("A.B", "A.B.C", False),
    ("A.?.C", "A.B.C", True), ("A.[!B].C", "A.B.C", False), ("A_B.C", "A.B.C", False), ("x, *.C", "a.b.c", True),
    ("A.B+.C", "A.BB.C", False), ("A.B.C", "A.B.C\n", False)])
def test_scope_globs(spark, scope, fqn, inside):
    row = spark.createDataFrame([(fqn,)], "t string").select(in_scope(F.col("t"), scope).alias("i")).first()
    assert row.i is inside


def test_severities_default_and_window(spark):
    results = frame(spark, result(1, "FAIL", severity="CRITICAL"), result(2, "ERROR", severity="HIGH"),
                    result(3, "FAIL", severity="LOW"), result(4, "FAIL", severity="HIGH", hours=6),
                    result(5, "FAIL", severity="HIGH", hours=5))
    rules = catalog(spark, 1, 2, 3, 4, 5)
    got = evaluate(spark, results, rules, {}, {"severity_filter": ""}, {"severity_filter": "low, HIGH"},
                   {"severity_filter": "MEDIUM"})
    assert [got[i].failures_count for i in (1, 2, 3, 4)] == [3, 3, 3, 0]
    assert got[4].status == "SKIPPED" and got[4].message_preview == "No matching failures" and got[4].message is None
    assert got[4].tables_affected is None and got[1].tables_affected == "D.S.T"
    assert evaluate(spark, results, rules, {}, test=True)[1].failures_count == 4


def test_window_and_latest_agree(spark):
    """A failure inside the window that was followed by a pass is not reported."""
    results = frame(spark, result(1, "FAIL", hours=3), result(1, "PASS", hours=1))
    assert evaluate(spark, results, catalog(spark, 1), {})[1].status == "SKIPPED"


def test_new_failures_only(spark):
    results = frame(
        spark, result(1, "FAIL"), result(1, "PASS", 1), result(2, "FAIL"), result(2, "FAIL", 1), result(3, "ERROR"),
        result(3, "PASS", 1), result(4, "FAIL"), result(4, "ERROR", 1), result(5, "FAIL"))
    rules = catalog(spark, 1, 2, 3, 4, 5)
    new = {"notify_mode": "NEW_FAILURES_ONLY"}
    got = evaluate(spark, results, rules, new, {})
    assert (got[1].failures_count, got[2].failures_count) == (3, 5)
    assert all(f"rule {i} " in got[1].message for i in (1, 3, 5))
    assert evaluate(spark, results, rules, new, test=True)[1].failures_count == 5
    nothing = evaluate(spark, frame(spark, result(2, "FAIL"), result(2, "FAIL", 1)), rules, new)
    assert nothing[1].message_preview == "No new failures since previous run"


def test_message_lists_25_lines_and_counts_the_rest(spark):
    results = frame(spark, *[result(i, "FAIL", table=f"D.S.T{i % 3}", pct=12.345) for i in range(1, 41)])
    row = evaluate(spark, results, catalog(spark, *range(1, 41)), {}, app_url="https://x", test=True)[1]
    lines = row.message.split("\n")
    assert lines[0] == "[TEST] Data Quality Alert: 40 check(s) failed" and len(lines) == 28
    assert lines[1] == "- [HIGH] rule 12 on D.S.T0: 12.35% failed (threshold 0.00%)" or lines[1].startswith("- [HIGH] rule ")
    assert lines[26:] == ["... and 15 more", "Open the app: https://x"]
    assert row.tables_affected == "D.S.T0, D.S.T1, D.S.T2"
    assert row.message_preview == row.message


def test_message_order_and_missing_numbers(spark):
    results = frame(
        spark, result(1, "FAIL", severity="HIGH", pct=0.125), result(2, "ERROR", severity="CRITICAL"),
        result(3, "FAIL", severity="HIGH", table="A.S.T", pct=50.0))
    message = evaluate(spark, results, catalog(spark, 1, 2, 3), {})[1].message
    assert message.split("\n")[1:] == [
        "- [CRITICAL] rule 2 on D.S.T: - failed (threshold 0.00%)",
        "- [HIGH] rule 3 on A.S.T: 50.00% failed (threshold 0.00%)",
        "- [HIGH] rule 1 on D.S.T: 0.12% failed (threshold 0.00%)"]


def test_low_scores_alert_without_failures(spark):
    results = frame(spark, result(1, "FAIL", 3, severity="LOW"), result(2, "PASS", 3, table="D.S.OK"))
    rules = catalog(spark, 1, 2)
    got = evaluate(spark, results, rules, {"min_score": 80.0}, {"min_score": 80.0, "scope_tables": "*.OK"},
                   {"min_score": 80.0, "channel_type": "SMS"})
    assert got[1].message == "Data Quality Alert: 0 check(s) failed\nTables below score 80: D.S.T (0.0)"
    assert (got[1].status, got[1].failures_count, got[1].tables_affected) == ("READY", 0, "")
    assert got[2].status == "SKIPPED"
    assert (got[3].status, got[3].error_message) == ("FAILED", "Unknown channel type: SMS")


def test_policy_selection(spark):
    rows = [{"is_enabled": False}, {}, {}]
    assert [p.alert_id for p in policies(spark, *rows)] == [2, 3]
    full = [tuple({"alert_id": i, "is_enabled": False}.get(n) for n in ALERT_POLICIES_SCHEMA.names) for i in (1, 2)]
    chosen = alerts.select_policies(spark.createDataFrame(full, ALERT_POLICIES_SCHEMA), alert_id=2)
    assert [p.alert_id for p in chosen] == [2]


def history(spark, *rows):
    full = [tuple(dict(history_id=f"{i:03d}", alert_name=name, status=status, sent_at=NOW - age).get(n)
                  for n in ALERT_HISTORY_SCHEMA.names) for i, (name, status, age) in enumerate(rows)]
    return spark.createDataFrame(full, ALERT_HISTORY_SCHEMA)


def test_last_evaluation_and_kpis(spark):
    minutes = lambda m: timedelta(minutes=m)
    rows = history(spark, ("a", "READY", minutes(0)), ("b", "READY", minutes(5)), ("c", "SKIPPED", minutes(4)),
                   ("d", "FAILED", minutes(6)))
    assert {(r.status, r.n) for r in alerts.last_evaluation(rows).collect()} == {("READY", 2), ("SKIPPED", 1)}
    assert tuple(alerts.notification_kpis(rows).first())[:4] == (2, 0, 1, 1)
    assert alerts.notification_history(rows, statuses=("FAILED",), limit=3).count() == 1


@pytest.mark.parametrize("value,kept", [("1", 2), ("0", 1), ("x", 3), (None, 3), ("", 3)])
def test_retention(spark, value, kept):
    rows = history(spark, ("a", "READY", timedelta(0)), ("b", "READY", timedelta(days=1)),
                   ("c", "READY", timedelta(days=90)), ("d", "READY", timedelta(days=90, seconds=1)))
    settings = spark.createDataFrame([("ALERT_HISTORY_RETENTION_DAYS", value, None)], SETTINGS_SCHEMA)
    assert alerts.retained_history(rows, settings, NOW).count() == kept
    if value is None:
        assert alerts.retained_history(rows, settings.where("false"), NOW).count() == 3


def test_policy_problems(spark):
    rows = spark.createDataFrame(
        [(1, "n", "EMAIL", "a@b.c, bad , Z@y.x", "HIGH", None), (2, "", "WEBHOOK", "hook", "", None),
         (3, "n", "EMAIL", None, None, 50.0), (4, "n", "WEBHOOK", "not an address", "LOW", None)],
        "alert_id int, alert_name string, channel_type string, recipients string, severity_filter string, min_score double")
    got = {r.alert_id: r for r in alerts.policy_problems(rows, allowed=["A@b.c"]).collect()}
    assert (got[1].malformed, got[1].not_allowed, got[1].is_valid) == (["bad"], ["Z@y.x"], False)
    assert got[2].problems == "pick a severity or a score threshold; name the policy"
    assert got[3].problems == "set recipients" and got[4].is_valid


def test_scope_options(spark):
    assert {r.scope for r in alerts.scope_options(catalog(spark, 1, 2)).collect()} == {"D.S.T", "D.S.*"}


def test_metrics(spark):
    table = spark.createDataFrame([(1, "a", NOW), (1, None, None), (2, None, NOW - timedelta(minutes=3))],
                                  "id int, txt string, at timestamp")
    rows = metrics.measure_table(table, "D.S.T", as_of=NOW, null_count=("txt",), duplicate_count=("id", "txt", ("id", "txt")),
                                 freshness=("at",))
    assert {(r.metric, r.arguments): r.value for r in rows.collect()} == {
        ("ROW_COUNT", None): 3.0, ("NULL_COUNT", "txt"): 1.0 + 1, ("FRESHNESS", "at"): 0.0, ("DUPLICATE_COUNT", "id"): 1.0,
        ("DUPLICATE_COUNT", "txt"): 1.0, ("DUPLICATE_COUNT", "id, txt"): 0.0}
    later = metrics.measure_table(table, "D.S.T", as_of=NOW + timedelta(hours=1), null_count=("txt",))
    series = rows.unionByName(later).select(*MEASUREMENTS_SCHEMA.names)
    newest = metrics.newest_measurements(series, NOW + timedelta(hours=2), 7)
    latest = metrics.latest_metrics(newest)
    assert latest.count() == 6
    assert {r.measured_at for r in latest.where("metric = 'ROW_COUNT'").collect()} == {NOW + timedelta(hours=1)}
    assert metrics.metric_series(newest, "D.S.T", "ROW_COUNT").count() == 2
    assert tuple(metrics.metric_kpis(newest).first()) == (1, 6, 8)
    assert metrics.newest_measurements(series, NOW + timedelta(days=8), 7).count() == 0


def test_missing_arguments_are_a_series(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d), "t", "m", a, float(d)) for d, a in ((1, None), (2, None), (1, ""))],
                                 MEASUREMENTS_SCHEMA)
    assert metrics.latest_metrics(rows).count() == 2
    chosen = metrics.latest_metrics(rows).where("arguments IS NULL")
    assert metrics.series_like(rows, chosen).count() == 2
