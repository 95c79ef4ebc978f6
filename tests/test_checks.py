"""Rule types on tiny frames: edges, invalid rules, display SQL, samples."""

from datetime import datetime, timedelta

import pytest

from plumbline.model import Rule
from plumbline.operators.checks import compile_rule, failing_rows
from plumbline.plans.engine import measure, run_checks
from plumbline.sources.registry import Registry

NOW = datetime(2024, 1, 31, 12, 0, 0)


def rule(kind, column="c", params=None, row_filter=None, table="t", **kw):
    return Rule(kw.pop("rule_id", 1), "r", "db", "sch", table, kind, column, params or {}, row_filter, **kw)


def counts(spark, frame, checked, **others):
    known = Registry(spark).register("DB.SCH.T", frame)
    for name, other in others.items():
        known.register(f"db.sch.{name}", other)
    row = measure({0: compile_rule(checked, NOW)}, known).first()
    return row["total_rows"], row["failed_rows"]


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def test_not_null(spark):
    assert counts(spark, strings(spark, "a", None, None), rule("NOT_NULL")) == (3, 2)


def test_unique_counts_every_row_of_a_repeated_key_and_null_keys(spark):
    frame = strings(spark, "a", "a", "b", None, None, None)
    assert counts(spark, frame, rule("UNIQUE")) == (6, 5)
    assert counts(spark, strings(spark, "a", None), rule("UNIQUE")) == (2, 0)


def test_unique_long_text_is_compared_whole(spark):
    import hashlib

    long = "x" * 70
    digest = hashlib.sha256(long.encode()).hexdigest()
    frame = strings(spark, long, long, long + "y", digest, "é" * 32, "é" * 32, "s" * 63, "s" * 63, None, None)
    assert counts(spark, frame, rule("UNIQUE")) == (10, 8)


def test_unique_composite(spark):
    frame = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (2, 1)], "a int, b int")
    assert counts(spark, frame, rule("UNIQUE", "a, b")) == (5, 4)


def test_accepted_values_compares_text_and_lets_null_pass(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    assert counts(spark, frame, rule("ACCEPTED_VALUES", params={"values": ["1"]})) == (3, 1)
    odd = strings(spark, "O'B", "a\\b", "x")
    assert counts(spark, odd, rule("ACCEPTED_VALUES", params={"values": ["O'B", "a\\b"]})) == (3, 1)


@pytest.mark.parametrize("params,failed", [
    ({"min": 0}, 1), ({"max": 5}, 1), ({"min": 0, "max": 5}, 2), ({"min": "0"}, 1), ({"min": -1.5}, 0)])
def test_range_bounds_are_inclusive_and_null_passes(spark, params, failed):
    frame = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (6.0,), (None,)], "c double")
    assert counts(spark, frame, rule("RANGE", params=params)) == (5, failed)


def test_range_on_decimals_and_dates(spark):
    prices = spark.sql("SELECT CAST(v AS DECIMAL(10,2)) AS c FROM VALUES (0.00), (0.01), (-0.01) AS t(v)")
    assert counts(spark, prices, rule("RANGE", params={"min": 0.01})) == (3, 2)
    days = spark.sql("SELECT DATE'2024-01-01' AS c UNION ALL SELECT DATE'2023-12-31'")
    assert counts(spark, days, rule("RANGE", params={"min": "2024-01-01"})) == (2, 1)


def test_regex_matches_the_whole_value(spark):
    frame = strings(spark, "12", "12\n", "x12", "", None)
    assert counts(spark, frame, rule("REGEX", params={"pattern": r"\d+"})) == (5, 3)
    assert counts(spark, frame, rule("REGEX", params={"pattern": r"^\d+$"})) == (5, 3)
    assert counts(spark, strings(spark, "a", "b", "ab"), rule("REGEX", params={"pattern": "a|b"})) == (3, 1)


@pytest.mark.parametrize("age,failed", [
    (timedelta(hours=2), 0), (timedelta(hours=2, seconds=59), 1), (timedelta(hours=2, minutes=1), 1), (timedelta(0), 0)])
def test_freshness_counts_minute_boundaries(spark, age, failed):
    frame = spark.createDataFrame([(NOW - age,), (NOW - timedelta(days=9),)], "c timestamp")
    assert counts(spark, frame, rule("FRESHNESS", params={"max_age_hours": 2})) == (1, failed)


def test_freshness_without_rows_or_values_fails(spark):
    assert counts(spark, spark.createDataFrame([], "c timestamp"), rule("FRESHNESS")) == (1, 1)
    assert counts(spark, spark.createDataFrame([(None,)], "c timestamp_ntz"), rule("FRESHNESS")) == (1, 1)


@pytest.mark.parametrize("params,failed", [({"min": 3}, 0), ({"min": 4}, 1), ({"max": 2}, 1), ({"min": 1, "max": 9}, 0)])
def test_row_count(spark, params, failed):
    assert counts(spark, strings(spark, "a", "b", "c"), rule("ROW_COUNT", None, params)) == (1, failed)


def test_referential_ignores_null_keys_on_both_sides(spark):
    child = strings(spark, "a", "a", "x", "x", None)
    parent = strings(spark, "a", "b", "b", None)
    checked = rule("REFERENTIAL", params={"ref_table": "db.sch.p", "ref_column": "C"})
    assert counts(spark, child, checked, p=parent) == (5, 2)
    assert counts(spark, child, checked, p=strings(spark)) == (5, 4)
    assert counts(spark, strings(spark), checked, p=parent) == (0, 0)


def test_custom_sql_with_row_filter_and_null_outcomes(spark):
    frame = spark.createDataFrame([(1, 2), (2, 1), (None, 1), (5, 1)], "a int, b int")
    checked = rule("CUSTOM_SQL", None, {"failure_condition": "a > b"}, "a < 5")
    assert counts(spark, frame, checked) == (2, 1)


def test_predicates_may_call_registered_functions(spark):
    spark.udf.register("is_odd", lambda v: v % 2 == 1, "boolean")
    frame = spark.createDataFrame([(1,), (2,), (3,)], "c int")
    assert counts(spark, frame, rule("CUSTOM_SQL", None, {"failure_condition": "is_odd(c)"})) == (3, 2)


def test_quoted_and_odd_names(spark):
    frame = spark.createDataFrame([(1,), (None,)], "`my col` int")
    assert counts(spark, frame, rule("NOT_NULL", '"my col"')) == (2, 1)
    assert counts(spark, frame, rule("UNIQUE", "my col")) == (2, 0)


def test_params_as_json_text(spark):
    assert counts(spark, strings(spark, "0", "2"), rule("RANGE", params='{"min": 1}')) == (2, 1)
    assert counts(spark, strings(spark, None), rule("NOT_NULL", params=" ")) == (1, 1)


@pytest.mark.parametrize("bad", [
    rule("NOPE"), rule("RANGE"), rule("ACCEPTED_VALUES", params={"values": []}), rule("NOT_NULL", None), rule("UNIQUE", " , "),
    rule("REFERENTIAL", params={"ref_table": "a.b.c"}), rule("REFERENTIAL", params={"ref_column": "c"}), rule("REGEX"),
    rule("ROW_COUNT", None), rule("CUSTOM_SQL"), rule("FRESHNESS", None), rule("RANGE", params={"min": "soon"})])
def test_invalid_rules_are_rejected(bad):
    with pytest.raises(ValueError):
        compile_rule(bad, NOW)


def shop(spark):
    orders = spark.createDataFrame(
        [(1, "a", 5.0, NOW, "x"), (2, "a", -1.0, NOW, None), (2, None, 3.0, None, "O'B"), (3, "zz", None, NOW, "x\\y"),
         (None, None, 1.0, NOW, "x"), (None, "zz", 1.0, NOW, "x")],
        "id int, customer string, amount double, at timestamp, tag string")
    customers = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    return Registry(spark).register("db.sch.orders", orders).register("db.sch.customers", customers)


RULES = [
    rule("NOT_NULL", "tag", table="orders"),
    rule("UNIQUE", "id", table="orders"),
    rule("UNIQUE", "id, customer", row_filter="amount > 0", table="orders"),
    rule("ACCEPTED_VALUES", "tag", {"values": ["x", "O'B"]}, table="orders"),
    rule("RANGE", "amount", {"min": 0, "max": 4.5}, table="orders"),
    rule("REGEX", "tag", {"pattern": r"[a-z]\\?.?"}, table="orders"),
    rule("FRESHNESS", "at", table="orders"),
    rule("ROW_COUNT", None, {"min": 7}, table="orders"),
    rule("REFERENTIAL", "customer", {"ref_table": "db.sch.customers", "ref_column": "id"}, table="orders"),
    rule("CUSTOM_SQL", None, {"failure_condition": "amount < id"}, "tag = 'x'", table="orders"),
]


@pytest.mark.parametrize("checked", RULES, ids=lambda r: r.rule_type)
def test_displayed_sql_counts_what_the_engine_counts(spark, checked):
    known = shop(spark)
    row = run_checks(spark, [checked], known, as_of=NOW).first()
    again = known.sql(row["check_sql"]).first()
    assert (row["total_rows"], row["failed_rows"]) == (again["total_rows"], again["failed_rows"])


@pytest.mark.parametrize("checked", RULES, ids=lambda r: r.rule_type)
def test_sample_has_the_failing_rows_and_agrees_with_the_displayed_sql(spark, checked):
    known = shop(spark)
    compiled = compile_rule(checked, NOW)
    rows = failing_rows(compiled, known).collect()
    shown = known.sql(compiled.sample_sql()).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, shown))
    if not compiled.detail:
        assert len(rows) == run_checks(spark, [checked], known, as_of=NOW).first()["failed_rows"]


def test_samples_stop_at_one_hundred_rows_in_key_order(spark):
    hot = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 7 ELSE id END AS c", "id AS n")
    known = Registry(spark).register("db.sch.t", hot).register("db.sch.p", spark.createDataFrame([(950,)], "id int"))
    rows = failing_rows(compile_rule(rule("UNIQUE"), NOW), known, order_by=("n",)).collect()
    assert [r["n"] for r in rows] == list(range(100))
    orphans = failing_rows(
        compile_rule(rule("REFERENTIAL", params={"ref_table": "db.sch.p", "ref_column": "id"}), NOW), known,
        order_by=("n",)).collect()
    assert [r["n"] for r in orphans] == list(range(100))
