"""Every registered query beside its SQL."""

import pytest

import __spark_entry__ as entry_point
from workload import ORACLE, QUERIES
from workload.compare import database, differences, type_differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return database(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(frame, connection, ORACLE[name]) == []
        assert type_differences(frame, connection, ORACLE[name]) == []
    else:
        assert frame.count() >= 0


# Queries that once behaved differently on larger tables, at the size at which they did.
LARGER = "/root/testdata/sf0.1"
SIZE_SENSITIVE = (
    "sensitive_guard", "suggest_rules", "suggest_confident", "profile_has_rule", "profile_kpis", "executions_per_day",
    "run_history_kpis", "results_csv", "notification_history", "notification_kpis", "metric_latest", "metric_kpis",
    "metric_series_of_latest", "alert_messages", "alert_messages_test", "alert_messages_store", "rule_store_edits",
    "policy_store_edits", "rules_csv_import", "two_writers", "newest_results_store", "table_statistics",
)


@pytest.mark.parametrize("name", SIZE_SENSITIVE)
def test_query_at_a_larger_size(spark, name):
    assert differences(QUERIES[name](spark, LARGER), database(LARGER), ORACLE[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 12
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
