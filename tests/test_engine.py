"""Runs: fusion, error isolation, rounding, selection, preview, summary."""

from datetime import datetime

import pytest

from plumbline.model import RESULTS_SCHEMA, RULES_SCHEMA, Rule
from plumbline.operators.checks import compile_rule
from plumbline.plans.engine import (
    MAX_FUSED, group_checks, judge, measure, preview_rules, preview_totals, run_checks, select_rules, stored_sample, summarize,
)
from plumbline.sources.registry import Registry
from workload.check_queries import BROKEN_RULES, RUN_RULES, inputs

NOW = datetime(2024, 1, 31)
SF = "/root/testdata/sf0.001"


def rule(number, kind, column="c", params=None, threshold=0.0, **kw):
    return Rule(number, f"rule {number}", "db", "sch", "t", kind, column, params or {}, threshold_pct=threshold, **kw)


def table(spark, rows=10):
    return Registry(spark).register("db.sch.t", spark.range(rows).selectExpr("id AS c", "CAST(id AS STRING) AS s"))


def test_result_rows_have_the_history_schema(spark):
    row = run_checks(spark, [rule(1, "RANGE", params={"max": 4}, severity="HIGH", dimension="Validity")], table(spark),
                     as_of=NOW, triggered_by="schedule")
    assert row.schema.names == RESULTS_SCHEMA.names
    got = row.first()
    assert (got.total_rows, got.failed_rows, got.failed_pct, got.status) == (10, 5, 50.0, "FAIL")
    assert (got.table_fqn, got.triggered_by, got.run_ts) == ("DB.SCH.T", "SCHEDULE", NOW)


def test_fused_equals_one_job_per_rule(spark):
    columns = ("rule_id", "total_rows", "failed_rows", "failed_pct", "status", "check_sql")
    known = inputs(spark, SF)
    fused = run_checks(spark, RUN_RULES, known, as_of=NOW).select(*columns).collect()
    single = run_checks(spark, RUN_RULES, known, as_of=NOW, fuse=False).select(*columns).collect()
    assert sorted(fused) == sorted(single)


def test_bad_rules_do_not_stop_the_others(spark):
    got = {r.rule_id: r for r in run_checks(spark, BROKEN_RULES, inputs(spark, SF), as_of=NOW).collect()}
    assert {i for i, r in got.items() if r.status == "ERROR"} == {1, 2, 3, 4, 5, 6, 7}
    assert all(r.error_message and len(r.error_message) <= 4000 for r in got.values() if r.status == "ERROR")
    assert all(r.total_rows is None and r.failed_pct is None for r in got.values() if r.status == "ERROR")
    assert got[9].status == "PASS" and got[8].total_rows == 1000


def test_run_time_failure_blames_only_its_rule(spark):
    rules = [rule(i, "CUSTOM_SQL", None, {"failure_condition": "c < 0"}) for i in range(1, 8)]
    rules.insert(4, rule(99, "CUSTOM_SQL", None, {"failure_condition": "CAST(concat('x', s) AS INT) > 1"}))
    got = {r.rule_id: r.status for r in run_checks(spark, rules, table(spark), as_of=NOW).collect()}
    assert got.pop(99) == "ERROR" and set(got.values()) == {"PASS"}


def test_a_failing_group_does_not_touch_the_others(spark):
    """The rule that fails at run time shares a job only with rules on its table and filter."""
    known = table(spark).register("db.sch.u", spark.range(3).toDF("c"))
    rules = [rule(1, "CUSTOM_SQL", None, {"failure_condition": "CAST(concat('x', s) AS INT) > 1"}), rule(2, "NOT_NULL"),
             Rule(3, "r", "db", "sch", "u", "NOT_NULL", "c"), rule(4, "NOT_NULL", row_filter="c > 1"), rule(5, "UNIQUE")]
    compiled = {r.rule_id: compile_rule(r, NOW) for r in rules}
    assert sorted(group_checks(compiled)) == [[1, 2], [3], [4], [5]]
    got = {r.rule_id: (r.status, r.total_rows) for r in run_checks(spark, rules, known, as_of=NOW).collect()}
    assert got == {1: ("ERROR", None), 2: ("PASS", 10), 3: ("PASS", 3), 4: ("PASS", 8), 5: ("PASS", 10)}


def test_more_rules_than_one_aggregate_holds(spark):
    many = [rule(i, "RANGE", params={"max": i - 1}) for i in range(1, MAX_FUSED + 30)]
    got = {r.rule_id: r.failed_rows for r in run_checks(spark, many, table(spark, 50), as_of=NOW).collect()}
    assert got == {i: max(0, 50 - i) for i in range(1, MAX_FUSED + 30)}


def test_one_scan_per_table_and_filter(spark):
    known = inputs(spark, SF)
    rules = [Rule(i, "r", "LAKE", "RETAIL", "orders", "RANGE", "o_totalprice", {"min": i}) for i in range(20)]
    plan = measure({i: compile_rule(r, NOW) for i, r in enumerate(rules)}, known)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan parquet") == 1


def test_pct_is_rounded_before_the_threshold(spark):
    columns = "run_id string, rule_id long, total_rows long, failed_rows long, threshold_pct double, error_message string"
    rows = [("r", 1, 3_000_000, 1, 0.0, None), ("r", 2, 3_000_000, 2, 0.0, None), ("r", 3, 0, 0, 0.0, None),
            ("r", 4, 100, 5, 5.0, None), ("r", 5, 100, 5, None, None), ("r", 6, None, None, 0.0, "broken")]
    frame = spark.createDataFrame(rows, columns)
    for field in RESULTS_SCHEMA.fields:
        if field.name not in frame.columns and field.name not in ("failed_pct", "status", "result_id"):
            from pyspark.sql import functions as F
            frame = frame.withColumn(field.name, F.lit(None).cast(field.dataType))
    got = {r.rule_id: (r.failed_pct, r.status) for r in judge(frame).collect()}
    assert got == {1: (0.0, "PASS"), 2: (0.0001, "FAIL"), 3: (0.0, "PASS"), 4: (5.0, "PASS"), 5: (5.0, "FAIL"),
                   6: (None, "ERROR")}


def test_empty_table(spark):
    known = Registry(spark).register("db.sch.t", spark.createDataFrame([], "c timestamp"))
    rules = [rule(1, "NOT_NULL"), rule(2, "UNIQUE"), rule(3, "FRESHNESS"), rule(4, "ROW_COUNT", None, {"min": 1})]
    got = {r.rule_id: r.status for r in run_checks(spark, rules, known, as_of=NOW).collect()}
    assert got == {1: "PASS", 2: "PASS", 3: "FAIL", 4: "FAIL"}


def test_selection_combines_table_and_id(spark):
    rows = [(i, f"r{i}", "", "Db", "Sch", t, "c", "NOT_NULL", "{}", None, 0.0, "LOW", "Validity", None, on, None, None, None)
            for i, t, on in ((3, "a", True), (1, "A", True), (2, "a", False), (4, "b", True))]
    catalog = spark.createDataFrame(rows, RULES_SCHEMA)
    assert [r.rule_id for r in select_rules(catalog)] == [1, 3, 4]
    assert [r.rule_id for r in select_rules(catalog, table="DB.sch.A")] == [1, 3]
    assert [r.rule_id for r in select_rules(catalog, table="db.sch.a", rule_id=4)] == []


def test_summary_and_preview(spark):
    rules = [rule(1, "RANGE", params={"max": 8}), rule(2, "NOT_NULL"), rule(3, "NOPE")] + [rule(i, "NOT_NULL") for i in range(4, 80)]
    summary = summarize(run_checks(spark, rules[:3], table(spark), as_of=NOW, run_id="x")).first()
    assert tuple(summary) == ("x", 3, 1, 1, 1)
    preview = preview_rules(spark, rules, table(spark, 3), as_of=NOW)
    assert preview.count() == 79
    assert tuple(preview_totals(preview).first()) == (78, 0, 1)


@pytest.mark.parametrize("places,pct", [(2, 33.33), (4, 33.3333)])
def test_preview_rounding(spark, places, pct):
    checked = [rule(1, "RANGE", params={"max": 1})]
    assert preview_rules(spark, checked, table(spark, 3), as_of=NOW, round_to=places).first().failed_pct == pct


def test_stored_sample_outlives_its_rule(spark):
    known = table(spark)
    results = run_checks(spark, [rule(1, "RANGE", params={"max": 6})], known, as_of=NOW, run_id="x")
    assert sorted(r.c for r in stored_sample(results, "x:1", known).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        stored_sample(results, "x:2", known)


def test_catalog_tables_need_no_registration(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS quality")
    spark.sql("DROP TABLE IF EXISTS quality.things")
    spark.sql(f"CREATE TABLE quality.things USING parquet LOCATION '{tmp_path}/things' AS SELECT id AS c FROM range(4)")
    checked = Rule(1, "r", "spark_catalog", "quality", "things", "UNIQUE", "c")
    assert run_checks(spark, [checked], Registry(spark), as_of=NOW).first().total_rows == 4
    found = Registry(spark).register_schema("", "quality")
    assert found.names() == ["quality.things"] and found.sizes().first().bytes > 0
    spark.sql("DROP DATABASE quality CASCADE")


def test_faults_of_the_cluster_are_raised_not_recorded(spark, monkeypatch):
    """A job that fails for another reason than data or expressions raises at once, without retries."""
    from pyspark.errors import PySparkException
    from plumbline.plans import engine

    class Broken:
        schema, tries = None, 0

        def collect(self):
            Broken.tries += 1
            raise PySparkException("Job aborted due to stage failure: ExecutorLostFailure")

    monkeypatch.setattr(engine, "measure", lambda checks, registry: Broken())
    with pytest.raises(PySparkException):
        run_checks(spark, [rule(i, "NOT_NULL") for i in range(1, 9)], table(spark), as_of=NOW)
    assert Broken.tries == 1
