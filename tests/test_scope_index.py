"""Many policies by an index of their scopes: the same rows as by predicates."""

import random

import pytest

from plumbline.model import ALERT_POLICIES_SCHEMA
from plumbline.operators import alerts
from plumbline.operators.scoring import latest_results, table_health
from tests.test_scoring import NOW, catalog, frame, result

TABLES = ("D.S.ORDERS", "d.s.orders", "D.S.ORDER_ITEMS", "D.T.STORES", "D.S.A[B", "X.Y.Z", "D.S.", None)
PIECES = ("D.S.ORDERS", "d.s.*", "*", "D.?.STORES", "*S", "D.S.A[[]B", "D.[ST].*", "", "x.y.z", "D.S.ORDER", "D.S.ORDER*", "?.Y.Z", "D.S.?*[SY]", "D.S.")


def policies(spark, n, seed=1):
    pick = random.Random(seed)
    rows = [(k, f"p{k}", "EMAIL", "a@b.c", pick.choice((None, "HIGH", "CRITICAL, low", "", "INFO")), pick.choice((None, 50.0, 101.0)), True, None, None,
             pick.choice((None, "NEW_FAILURES_ONLY")), pick.choice((None, ",".join(pick.choice(PIECES) for _ in range(pick.randrange(4))))))
            for k in range(n)]
    return alerts.select_policies(spark.createDataFrame(rows, ALERT_POLICIES_SCHEMA))


@pytest.fixture(scope="module")
def results(spark):
    pick, rows = random.Random(2), []
    for k in range(40):
        rows += [result(k, pick.choice(("PASS", "FAIL", "ERROR")), 1, table=TABLES[k % 8]),
                 result(k, pick.choice(("PASS", "FAIL", "FAIL", "ERROR")), severity=pick.choice(("HIGH", "CRITICAL", "LOW", "INFO", None)), table=TABLES[k % 8])]
    return frame(spark, *rows)


@pytest.mark.parametrize("test", [True, False])
def test_index_and_predicates_agree(spark, results, monkeypatch, test):
    chosen, rules = policies(spark, 90), catalog(spark, *range(40))
    failures = alerts.current_failures(results, rules, NOW, test)
    health = table_health(latest_results(results, rules))

    def rows():
        matched = alerts.matched_failures(failures, results, chosen, test)
        low = alerts.low_score_tables(health, chosen)
        return (matched.columns, sorted(map(str, matched.select("alert_id", "rule_id", "table_fqn", "status").collect())),
                low.columns, sorted(map(str, low.collect())))

    indexed = rows()
    monkeypatch.setattr(alerts, "FEW_POLICIES", 10_000)
    assert indexed[0] and rows() == (indexed[0], indexed[1], indexed[2], indexed[3]) and len(indexed[1]) > 100


def test_ten_thousand_policies(spark, results):
    chosen = policies(spark, 10_000, seed=3)
    evaluated = alerts.evaluate_alerts(spark, results, catalog(spark, *range(40)), chosen, NOW)
    got = {r.status: r["n"] for r in alerts.evaluation_summary(evaluated).collect()}
    assert sum(got.values()) == 10_000 and got["READY"] > 1000 and got["SKIPPED"] > 100


def test_low_scores_build_no_expression_per_policy(spark, results, monkeypatch):
    health = table_health(latest_results(results, catalog(spark, *range(40))))
    chosen = policies(spark, 90, seed=4)
    monkeypatch.setattr(alerts, "FEW_POLICIES", 10_000)
    expected = sorted(map(str, alerts.low_score_tables(health, chosen).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(alerts, "in_scope", None)
    assert sorted(map(str, alerts.low_score_tables(health, chosen).collect())) == expected and expected


def test_policies_of_a_frame_never_reach_the_driver(spark, results, monkeypatch):
    """The same rows in chunks of a few policies, with ids that are shared or null, and pairs alone grow as a product."""
    rules = catalog(spark, *range(40))
    failures, health = alerts.current_failures(results, rules, NOW), table_health(latest_results(results, rules))
    rows = [tuple(p) for p in policies(spark, 80, seed=5)]
    rows = [(k % 50, *r[1:]) for k, r in enumerate(rows)] + rows[:5]
    frame = spark.createDataFrame([*rows, (None, *rows[0][1:])], ALERT_POLICIES_SCHEMA)

    def found(chosen):
        return [sorted(map(str, rows.collect())) for rows in (
            alerts.matched_failures(failures, results, chosen).select("alert_id", "rule_id", "table_fqn", "status"),
            alerts.low_score_tables(health, chosen))]

    monkeypatch.setattr(alerts, "CHUNK", 3)
    lazy = alerts.policy_frame(frame)
    monkeypatch.setattr(type(lazy), "collect", lambda self: pytest.fail("collected"))
    planned = alerts.matched_failures(failures, results, lazy), alerts.low_score_tables(health, lazy)
    assert all(p.columns for p in planned)
    monkeypatch.undo()
    monkeypatch.setattr(alerts, "CHUNK", 3)
    got = found(lazy)
    monkeypatch.setattr(alerts, "FEW_POLICIES", 10_000)
    assert got == found(alerts.select_policies(frame)) and all(got)
