"""Profiles: NULLs, types, sampling, sensitive columns, suggestions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from plumbline.functions.text import significant
from plumbline.operators.profile import family, profile_table, profile_tables, sampling_pct, sensitive_columns
from plumbline.operators.suggest import find_parents, suggest_rules, to_catalog_rows

NOW = datetime(2024, 1, 31)


def by_column(profile):
    return {r.column_name: r for r in profile.collect()}


@pytest.mark.parametrize("rows,pct", [(0, None), (500_000, None), (500_001, 100.0), (1_000_000, 50.0), (3_000_000, 16.7),
                                      (10**9, 0.1), (10**12, 0.1)])
def test_sampling_rate(rows, pct):
    assert sampling_pct(rows) == pct


def test_every_type(spark):
    frame = spark.sql("""
        SELECT * FROM VALUES
          (1, CAST(1.5 AS DOUBLE), 'a', true, DATE'2024-01-01', TIMESTAMP'2024-01-30 23:59:59', array(1), map('k', 1), X'00', 1.10BD),
          (2, CAST(-0.0 AS DOUBLE), 'b', false, DATE'2023-01-01', TIMESTAMP'2024-01-01 00:00:00', array(1), map('k', 2), X'01', -2.50BD),
          (3, CAST(0.0 AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(id, num, txt, flag, day, at, arr, mapped, bin, money)""")
    got = by_column(profile_table(frame, "t", as_of=NOW))
    assert {n: r.family for n, r in got.items()} == {
        "id": "numeric", "num": "numeric", "txt": "text", "flag": "other", "day": "temporal", "at": "temporal",
        "arr": "complex", "mapped": "complex", "bin": "complex", "money": "numeric"}
    assert {n: r.distinct_count for n, r in got.items()} == {
        "id": 3, "num": 2, "txt": 2, "flag": 2, "day": 2, "at": 2, "arr": 1, "mapped": 2, "bin": 2, "money": 2}
    assert {n: r.null_count for n, r in got.items()} == {
        "id": 0, "num": 0, "txt": 1, "flag": 1, "day": 1, "at": 1, "arr": 1, "mapped": 1, "bin": 1, "money": 1}
    assert got["at"].age_hours == pytest.approx(1 / 60) and got["day"].age_hours == 720.0 and got["id"].age_hours is None
    assert (got["money"].min_value, got["money"].max_value) == ("-2.50", "1.10")
    assert (got["day"].min_value, got["day"].sample_values) == ("2023-01-01", "2023-01-01, 2024-01-01")
    assert got["flag"].values_list is None and got["flag"].sample_values == "false, true"
    assert got["txt"].values_list == ["a", "b"] and got["arr"].min_value is None and got["arr"].sample_values == ""
    assert (got["txt"].null_pct, got["txt"].uniqueness_pct) == (33.33, 66.67)
    assert got["money"].signals == "categorical, high nulls, negatives"
    assert got["at"].signals == "timestamp, high nulls"


def test_empty_and_all_null(spark):
    empty = by_column(profile_table(spark.createDataFrame([], "a int, b string"), "t", as_of=NOW))
    assert empty["a"].total_rows == 0 and empty["a"].null_pct == 0.0 and empty["b"].values_list is None
    nulls = by_column(profile_table(spark.createDataFrame([(None,)] * 3, "a string"), "t", as_of=NOW))
    assert (nulls["a"].distinct_count, nulls["a"].null_pct, nulls["a"].sample_values) == (0, 100.0, "")


def test_wide_tables_take_several_passes(spark):
    frame = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    got = by_column(profile_table(frame, "t", as_of=NOW))
    assert {n: r.distinct_count for n, r in got.items()} == {f"c{i}": min(i + 1, 20) for i in range(60)}
    assert [got[f"c{i}"].ordinal_position for i in range(60)] == list(range(1, 61))


def test_many_tables_and_a_broken_one(spark):
    broken = spark.range(3).selectExpr("CAST(concat('x', id) AS INT) AS c")
    frames = {"a": spark.range(5).toDF("n"), "b": broken, "c": spark.range(7).toDF("n"), "none": spark.range(0).toDF("n")}
    failures = {}
    got = profile_tables(frames, as_of=NOW, row_counts={"a": 5, "none": 0}, failures=failures).collect()
    assert {(r.table_name, r.distinct_count) for r in got} == {("a", 5), ("c", 7)}
    assert list(failures) == ["b"]
    with pytest.raises(Exception):
        profile_tables(frames, as_of=NOW)


def test_categorical_limit(spark):
    frame = spark.range(100).selectExpr("id % 25 AS yes", "id % 26 AS no", "CAST(id % 9 AS STRING) AS txt")
    got = by_column(profile_table(frame, "t", as_of=NOW))
    assert len(got["yes"].values_list) == 25 and got["no"].values_list is None
    assert got["txt"].values_list == [str(i) for i in range(9)]


def test_large_tables_are_profiled_exactly(spark):
    frame = spark.range(700_000).selectExpr(
        "id", "id % 5 AS few", "CASE WHEN id < 699990 THEN 'usual' ELSE concat('rare', id % 3) END AS mostly",
        "CASE WHEN id % 40 = 7 THEN id ELSE 0 END AS hidden")
    got = by_column(profile_table(frame, "t", as_of=NOW))
    assert got["id"].total_rows == got["id"].distinct_count == 700_000 and got["id"].sampled_pct is None
    assert got["few"].values_list == ["0", "1", "2", "3", "4"]
    assert got["mostly"].values_list == ["rare0", "rare1", "rare2", "usual"]
    assert got["hidden"].values_list is None


def test_a_sample_is_asked_for_and_named(spark):
    got = by_column(profile_table(spark.range(20_000).toDF("id"), "t", as_of=NOW, sample_pct=5.0, seed=1))
    assert 700 < got["id"].total_rows < 1300 and got["id"].sampled_pct == 5.0


def test_texts_that_begin_alike(spark):
    frame = spark.range(60).selectExpr("concat(repeat('x', 80), lpad(id, 3, '0')) AS t", "concat('y', repeat('z', 70), id % 3) AS u")
    got = by_column(profile_table(frame, "t", as_of=NOW))
    assert got["t"].sample_values == ", ".join("x" * 80 + f"{i:03}" for i in range(5))
    assert got["u"].values_list == ["y" + "z" * 70 + str(i) for i in range(3)] and got["t"].distinct_count == 60


def test_guarded_profiles_scan_no_more(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id AS string) AS t", "id * 1.5D AS v", "array(id) AS a").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))

    def scans(sensitive):
        plan = profile_table(frame, "t", as_of=NOW, sensitive=sensitive)._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan parquet")

    assert scans({"t": "x"}) <= scans({}) == scans({"v": "x", "a": "x"}) <= 6


def test_sensitive_values_are_never_read(spark):
    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("Email_Work", T.StringType()),
        T.StructField("birth_ts", T.TimestampType()),
        T.StructField("note", T.StringType(), metadata={"semantic_category": "NAME"}),
        T.StructField("salary", T.IntegerType(), metadata={"masking_policy": "hr"})])
    frame = spark.createDataFrame([(1, "a@b.c", NOW, "Ann", 10), (2, "a@b.c", NOW, None, 20)], schema)
    assert sensitive_columns(frame.schema) == {
        "Email_Work": "name suggests PII", "birth_ts": "name suggests PII", "note": "classified NAME", "salary": "masking policy"}
    got = by_column(profile_table(frame, "t", as_of=NOW))
    for name in ("Email_Work", "birth_ts", "note", "salary"):
        row = got[name]
        assert (row.min_value, row.max_value, row.age_hours, row.sample_values, row.values_list) == (None, None, None, "", None)
    assert (got["Email_Work"].distinct_count, got["note"].null_count) == (1, 1)
    assert got["note"].signals.startswith("sensitive (classified NAME)")


def test_family_of_char_columns():
    assert family(T.VarcharType(5)) == "text" and family(T.BooleanType()) == "other"


COLUMNS = [("orders", "order_id", 1), ("orders", "customer_id", 2), ("customers", "CUSTOMER_ID", 1), ("returns", "order_id", 2),
           ("order_log", "order_id", 1), ("vip_customers", "customer_id", 1), ("visits", "visit_id", 1), ("visits", "page_id", 2),
           ("pages", "title", 1), ("pages", "page_id", 2), ("misc", "page_id", 3), ("misc", "odd_id", 4)]


def test_parent_finder(spark):
    columns = spark.createDataFrame(COLUMNS, "table_name string, column_name string, ordinal_position int")
    got = {(r.table_name, r.column_name): (r.parent, r.parent_confidence) for r in find_parents(columns).collect()}
    assert got == {
        ("orders", "customer_id"): ("customers", "high"),
        ("returns", "order_id"): ("order_log", "high"),
        ("visits", "page_id"): ("pages", "medium"),
        ("misc", "page_id"): ("pages", "medium"),
    }


def profile_row(table, column, position=2, kind="text", total=1000, null_pct=1.0, unique=5.0, low=None, age=None, values=None):
    return (table, column, kind, position, total, null_pct, unique, low, age, values)


PROFILE = ("table_name string, column_name string, family string, ordinal_position int, total_rows long, null_pct double, "
           "uniqueness_pct double, min_value string, age_hours double, values_list array<string>")


def suggest(spark, rows, existing=(), columns=COLUMNS, counts=()):
    return {
        (r.column_name, r.rule_type): r for r in suggest_rules(
            spark.createDataFrame(rows, PROFILE),
            spark.createDataFrame(list(existing), "table_name string, column_name string, rule_type string"),
            spark.createDataFrame(columns, "table_name string, column_name string, ordinal_position int"),
            spark.createDataFrame(list(counts), "table_name string, row_count long"), "D", "S").collect()}


def test_suggestions_per_branch(spark):
    values = [str(i) for i in range(8)]
    got = suggest(spark, [
        profile_row("orders", "order_id", 1, "numeric", null_pct=0.0, unique=98.5),
        profile_row("orders", "customer_id", 2, "numeric", null_pct=0.0, low="-5"),
        profile_row("orders", "Status", values=values),
        profile_row("orders", "note", null_pct=0.0, total=100),
        profile_row("orders", "extra", null_pct=0.0),
        profile_row("orders", "amount", kind="numeric", low="-1234567.5"),
        profile_row("orders", "delta", kind="numeric", low="-0.25"),
        profile_row("orders", "loaded_at", kind="temporal", age=1234.56),
        profile_row("orders", "created", kind="temporal", age=3.0),
        profile_row("orders", "updated", kind="temporal"),
        profile_row("orders", "email_addr"), profile_row("orders", "phone"),
    ], counts=[("orders", 1234567), ("empty", 0), ("tiny", 1)])
    assert got["order_id", "UNIQUE"].confidence == "medium" and got["order_id", "UNIQUE"].reason == "98.5% unique — duplicates present"
    assert got["order_id", "NOT_NULL"].severity == "CRITICAL" and got["order_id", "NOT_NULL"].reason == "First column, 0.0% nulls"
    parent = got["customer_id", "REFERENTIAL"]
    assert json.loads(parent.rule_params) == {"ref_table": "D.S.customers", "ref_column": "customer_id"}
    assert (parent.severity, parent.threshold_pct, parent.confidence) == ("HIGH", 0.1, "high")
    assert ("customer_id", "RANGE") not in got
    assert got["customer_id", "NOT_NULL"].confidence == "medium" and got["extra", "NOT_NULL"].confidence == "low"
    assert ("note", "NOT_NULL") not in got
    accepted = got["Status", "ACCEPTED_VALUES"]
    assert json.loads(accepted.rule_params) == {"values": values}
    assert accepted.reason == "8 distinct values (full table): 0, 1, 2, 3, 4, 5…"
    assert got["amount", "RANGE"].reason == "Min value -1.23457e+06 — name implies non-negative"
    assert (got["delta", "RANGE"].confidence, got["delta", "RANGE"].reason) == ("low", "Min value -0.25")
    assert got["loaded_at", "FRESHNESS"].reason == "Latest value 1,234.6h old — would FAIL at 24h"
    assert got["created", "FRESHNESS"].reason == "Latest value 3.0h old — would PASS at 24h"
    assert got["updated", "FRESHNESS"].reason == "Load timestamp column"
    assert got["email_addr", "REGEX"].threshold_pct == 2.0 and got["phone", "REGEX"].severity == "LOW"
    volume = got[None, "ROW_COUNT"]
    assert volume.table_name in ("orders", "tiny")
    assert ("empty", "ROW_COUNT") not in {(r.table_name, r.rule_type) for r in got.values()}


def test_volume_bounds_and_covered_rules(spark):
    rows = [profile_row("orders", "order_id", 1, "numeric", unique=100.0)]
    got = suggest(spark, rows, existing=[("orders", "ORDER_ID", "unique")], counts=[("orders", 1234567)])
    assert set(got) == {("order_id", "NOT_NULL"), (None, "ROW_COUNT")}
    assert json.loads(got[None, "ROW_COUNT"].rule_params) == {"min": 987653, "max": 2469134}
    assert got[None, "ROW_COUNT"].reason == "Current 1,234,567 rows; bounds 80%–200%"
    covered = suggest(spark, rows, existing=[("orders", None, "ROW_COUNT")], counts=[("orders", 1)])
    assert (None, "ROW_COUNT") not in covered


def test_suggestions_become_catalog_rows(spark):
    columns = spark.createDataFrame(COLUMNS, "table_name string, column_name string, ordinal_position int")
    found = suggest_rules(spark.createDataFrame([profile_row("orders", "order_id", 1, "numeric")], PROFILE),
                          spark.createDataFrame([], "table_name string, column_name string, rule_type string"), columns,
                          spark.createDataFrame([], "table_name string, row_count long"), "D", "S")
    rows = {r.rule_type: r for r in to_catalog_rows(found, "D", "S", owner="", row_filter="x > 1").collect()}
    assert rows["UNIQUE"].dimension == "Uniqueness" and rows["NOT_NULL"].dimension == "Completeness"
    assert rows["UNIQUE"].owner is None and rows["UNIQUE"].row_filter == "x > 1"


@pytest.mark.parametrize("value", [-0.01, -999.99, -123456.789, -1234567.0, -0.0000123, 0.0, -100.0, -5.0, 999999.5, 1e15, -2.5e-7])
def test_general_number_text(spark, value):
    got = spark.createDataFrame([(value,)], "x double").select(significant(F.col("x")).alias("t")).first().t
    assert got == f"{value:g}"
