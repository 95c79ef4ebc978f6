"""The store: catalog edits, history, retention, CSV, and whole workflows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.scoring import latest_results
from plumbline.plans.workflow import apply_suggestions, notify, run_and_record
from plumbline.operators.suggest import by_confidence, suggest_rules
from plumbline.operators.profile import profile_table
from plumbline.sources.csv import export_rules, import_rules
from plumbline.sources.registry import Registry
from plumbline.sources.tables import (
    ALERT_HISTORY, POLICIES, RESULTS, RULES, SETTINGS, Store, changed_rows, delete_rows, merge_rows,
)
from tests.test_scoring import NOW, frame, result


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rule(name, **kw):
    return dict(rule_name=name, database_name="D", schema_name="S", table_name="T", column_name="c", rule_type="NOT_NULL", **kw)


def test_insert_fills_defaults_and_ids_go_up(store):
    assert store.rows(RULES).count() == 0
    assert store.insert(RULES, [rule("a"), rule("b", severity="LOW", threshold_pct=2.0)], as_of=NOW) == [1, 2]
    store.delete(RULES, [2])
    assert store.insert(RULES, [rule("c")], as_of=NOW) == [3]
    got = {r.rule_id: r for r in store.rows(RULES).collect()}
    assert set(got) == {1, 3}
    assert (got[1].severity, got[1].dimension, got[1].threshold_pct, got[1].is_active, got[1].rule_params) == (
        "MEDIUM", "Validity", 0.0, True, "{}")


def test_update_writes_changed_rows_only(store):
    store.insert(RULES, [rule("a"), rule("b", owner="x")], as_of=NOW)
    later = NOW + timedelta(days=1)
    edited = store.rows(RULES).select("rule_id", "is_active", "threshold_pct", "severity",
                                      F.when(F.col("rule_id") == 1, "y").otherwise(F.col("owner")).alias("owner"))
    columns = ("is_active", "threshold_pct", "severity", "owner")
    assert store.update(RULES, edited, as_of=later, columns=columns) == 1
    assert store.update(RULES, edited, as_of=later, columns=columns) == 0
    got = {r.rule_id: (r.rule_name, r.owner, r.updated_at) for r in store.rows(RULES).collect()}
    assert got == {1: ("a", "y", later), 2: ("b", "x", NOW)}


def test_history_survives_rule_deletion(store):
    store.insert(RULES, [rule("a")], as_of=NOW)
    store.append(RESULTS, frame(store.spark, result(1, "PASS"), result(1, "FAIL", 1)))
    store.delete(RULES, [1])
    assert store.read(RESULTS).count() == 2
    assert latest_results(store.read(RESULTS), store.rows(RULES)).count() == 0


def test_history_is_partitioned_and_pruned_by_day(store):
    store.append(RESULTS, frame(store.spark, *[result(i, "PASS", i) for i in range(10)], result(90, "FAIL", 5, hours=3),
                                result(91, "FAIL", 5, hours=-2)))
    plan = store.read(RESULTS).where(F.col("run_date") == date(2024, 1, 30))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan
    for _ in range(2):
        store.prune(RESULTS, NOW, 5)
        assert sorted(r.rule_id for r in store.read(RESULTS).collect()) == [0, 1, 2, 3, 4, 5, 91]
    store.prune(RESULTS, NOW + timedelta(days=20), 1)
    assert store.read(RESULTS).count() == 0


def test_settings_and_alert_retention(store):
    store.initialise(NOW)
    store.set_settings({"APP_URL": "https://x", "ALERT_HISTORY_RETENTION_DAYS": "2"}, as_of=NOW)
    store.initialise(NOW)
    assert store.setting("APP_URL") == "https://x" and store.rows(SETTINGS).count() == 2
    store.insert(POLICIES, [dict(alert_name="p", channel_type="EMAIL", recipients="a@b.c")], as_of=NOW)
    policy = store.rows(POLICIES).first()
    assert (policy.severity_filter, policy.notify_mode, policy.is_enabled) == ("CRITICAL,HIGH", "ALL_FAILURES", True)
    for days in range(4):
        assert notify(store, as_of=NOW - timedelta(days=days)).count() == 1
    store.apply_alert_retention(NOW)
    assert store.read(ALERT_HISTORY).count() == 3
    toggled = store.rows(POLICIES).withColumn("is_enabled", F.lit(False))
    assert store.update(POLICIES, toggled, as_of=NOW, columns=("is_enabled",)) == 1
    assert notify(store, as_of=NOW) is None


def test_merge_delete_and_change_detection(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "k int, v string, kept double")
    updates = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, v string")
    assert {tuple(r) for r in merge_rows(target, updates, ["k"]).collect()} == {
        (1, "a", 1.0), (2, "B", None), (3, None, 3.0), (4, "d", None)}
    assert {tuple(r) for r in merge_rows(target, updates, ["k"], insert_only=True).collect()} == {
        (1, "a", 1.0), (2, "b", None), (3, None, 3.0), (4, "d", None)}
    assert [r.k for r in delete_rows(target, updates, ["k"]).collect()] == [1]
    assert [r.k for r in changed_rows(target, updates, "k", ["v"]).collect()] == [2]


def test_csv_round_trip(store, tmp_path):
    store.insert(RULES, [rule("a, \"quoted\"\nline", rule_params='{"values": ["x,y", "O\'B"]}'), rule("b", row_filter="x = 'a'")],
                 as_of=NOW)
    path = str(tmp_path / "rules")
    export_rules(store.rows(RULES), path)
    columns = ("rule_name", "rule_params", "row_filter", "severity", "threshold_pct")
    again = import_rules(store.spark, path)
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(
        map(tuple, store.rows(RULES).select(*columns).collect()))


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_import_defaults_and_rejections(spark, tmp_path):
    head = "RULE_TYPE,RULE_NAME,DATABASE_NAME,SCHEMA_NAME,TABLE_NAME,SEVERITY\n"
    row = import_rules(spark, write(tmp_path / "a.csv", head + "unique,n,D,S,T,\n")).first()
    assert (row.rule_type, row.severity, row.dimension, row.rule_params, row.threshold_pct) == (
        "UNIQUE", "MEDIUM", "Validity", "{}", 0.0)
    with pytest.raises(ValueError, match="unknown rule types: \\['ODD'\\]"):
        import_rules(spark, write(tmp_path / "b.csv", head + "odd,n,D,S,T,low\n"))
    with pytest.raises(ValueError, match="missing columns: \\['table_name', 'rule_type'\\]"):
        import_rules(spark, write(tmp_path / "c.csv", "RULE_NAME,DATABASE_NAME,SCHEMA_NAME\nn,D,S\n"))


def test_table_sizes_are_the_file_sizes(spark):
    import os

    from workload.base import TABLES, registry

    got = {r.table_fqn.split(".")[-1]: r.bytes for r in registry(spark, "/root/testdata/sf0.001").sizes().collect()}
    assert got == {t: os.path.getsize(f"/root/testdata/sf0.001/{t}.parquet") for t in TABLES}
    derived = Registry(spark).register("a.b.c", spark.range(3).toDF("n")).sizes().first()
    assert derived.bytes is None and derived.last_altered is None


def test_profile_suggest_apply_run(store):
    frame_ = store.spark.range(200).selectExpr("id AS user_id", "CASE WHEN id % 2 = 0 THEN 'on' ELSE 'off' END AS status",
                                               "CAST(id - 1 AS DOUBLE) AS amount")
    known = Registry(store.spark).register("D.S.USERS", frame_)
    found = suggest_rules(
        profile_table(frame_, "USERS", as_of=NOW),
        store.rows(RULES).select("table_name", "column_name", "rule_type"), known.columns(), known.row_counts(), "D", "S")
    totals = apply_suggestions(store, known, by_confidence(found, "medium"), "D", "S", as_of=NOW, owner="team")
    assert totals == {"rules": 7, "tables": 1, "PASS": 7, "FAIL": 0, "ERROR": 0}
    assert store.read(RESULTS).count() == 7
    covered = suggest_rules(
        profile_table(frame_, "USERS", as_of=NOW),
        store.rows(RULES).select("table_name", "column_name", "rule_type"), known.columns(), known.row_counts(), "D", "S")
    assert by_confidence(covered, "medium").count() == 0


def test_run_notify_and_return_what_was_logged(store):
    known = Registry(store.spark).register("D.S.T", store.spark.range(10).toDF("n"))
    store.insert(RULES, [dict(rule_name="r", database_name="D", schema_name="S", table_name="T", column_name="n",
                              rule_type="RANGE", rule_params='{"max": 5}', severity="CRITICAL")], as_of=NOW)
    assert run_and_record(store, known, as_of=NOW).first().status == "FAIL"
    assert run_and_record(store, known, as_of=NOW + timedelta(hours=1), table="d.s.t").count() == 1
    store.insert(POLICIES, [dict(alert_name="p", channel_type="EMAIL", recipients="a@b.c", min_score=99.0)], as_of=NOW)
    logged = notify(store, as_of=NOW + timedelta(hours=2))
    run_and_record(store, known.register("D.S.T", store.spark.range(3).toDF("n")), as_of=NOW + timedelta(hours=1, minutes=30))
    row = logged.first()
    assert row.status == "READY" and "Tables below score 99" in row.message
    assert store.read(ALERT_HISTORY).first().message_preview == row.message_preview


def test_compaction_keeps_rows_and_used_ids(store):
    ids = store.insert(RULES, [dict(rule_name=f"r{k}", rule_type="UNIQUE") for k in range(4)], as_of=NOW)
    store.delete(RULES, ids[2:])
    before = sorted(map(tuple, store.rows(RULES).collect()))
    store.compact(RULES)
    assert sorted(map(tuple, store.rows(RULES).collect())) == before and len(store.rows(RULES).inputFiles()) == 1
    assert store.insert(RULES, [dict(rule_name="new", rule_type="UNIQUE")], as_of=NOW) == [5]


def test_logs_are_pruned_by_day(store):
    """Windows over the three logs read the days they need, by a filter on the partition column."""
    from plumbline.operators import alerts, metrics, reports
    from plumbline.sources.tables import MEASUREMENTS

    for log in (RESULTS, ALERT_HISTORY, MEASUREMENTS):
        moment = [None if f.name != log.moment else NOW for f in log.schema.fields]
        store.append(log, store.spark.createDataFrame([tuple(moment)], log.schema))
    for rows in (reports.run_history(store.read(RESULTS), NOW), metrics.newest_measurements(store.read(MEASUREMENTS), NOW),
                 alerts.last_evaluation(store.read(ALERT_HISTORY))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(" in plan
