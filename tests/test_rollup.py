"""Counts per day over a store, and the newest rows of a log."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import reports, scoring
from plumbline.sources.tables import RESULTS, Store
from tests.test_scoring import NOW, frame, result


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def agrees(store):
    whole = store.read(RESULTS)
    daily, rolled = scoring.daily_results(whole), store.rollup()
    assert same(rolled, scoring.daily_rollup(whole))
    assert same(scoring.rolled_table_score(rolled), scoring.daily_table_score(daily))
    assert same(scoring.rolled_score_trend(rolled, NOW, 30), scoring.score_trend(daily, NOW, 30))


def test_rollup_follows_late_and_dropped_results(store):
    agrees(store)
    store.append(RESULTS, frame(store.spark, *[result(r, s, day, sev) for day in range(8) for r, s, sev in (
        (1, "PASS", "HIGH"), (2, "FAIL", "CRITICAL"), (3, "ERROR", "odd"), (4, "PASS", None))]))
    agrees(store)                                             # nothing stored yet: counted from the results
    assert store.refresh_rollup() == 8 and store.refresh_rollup() == 0
    agrees(store)
    store.append(RESULTS, frame(store.spark, result(1, "FAIL", 2, hours=-1), result(1, "PASS", 5, hours=1), result(9, "PASS", 30)))
    agrees(store)
    assert store.refresh_rollup() == 3                        # the days that late results came to
    store.prune(RESULTS, NOW, 4)
    agrees(store)
    assert store.refresh_rollup() == 1                        # the boundary day
    agrees(store)
    moment = RESULTS.schema.names.index("run_ts")
    undated = list(result(5, "PASS"))
    undated[moment] = None
    store.append(RESULTS, store.spark.createDataFrame([tuple(undated)], RESULTS.schema))
    assert store.refresh_rollup() == 1
    agrees(store)


def test_fresh_days_are_not_read(store):
    store.append(RESULTS, frame(store.spark, *[result(1, "PASS", day) for day in range(5)]))
    store.refresh_rollup()
    assert "run_ts" not in store.rollup()._jdf.queryExecution().executedPlan().toString()       # no result is read
    store.append(RESULTS, frame(store.spark, result(2, "FAIL", 3)))
    plan = store.rollup()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run_date", plan) and "run_ts" in plan


def test_two_refreshes_at_once(store):
    store.append(RESULTS, frame(store.spark, *[result(1, "PASS", day) for day in range(3)]))
    Store(store.spark, store.root).refresh_rollup()
    store.refresh_rollup()
    agrees(store)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_newest_rows_walk_the_days(store, monkeypatch, n):
    rows = [result(r, "FAIL" if r == 1 and day % 3 == 2 else "PASS", day, suffix=s) for day in range(12) for r in (1, 2) for s in "ab"]
    store.append(RESULTS, frame(store.spark, *rows))
    proper, reads = Store.read, []
    monkeypatch.setattr(Store, "read", lambda self, log: reads.append(1) or proper(self, log))
    for where in (None, F.col("status") == "FAIL"):
        reads.clear()
        got = [r.result_id for r in store.newest(RESULTS, n, where).collect()]
        wanted = proper(store, RESULTS) if where is None else proper(store, RESULTS).where(where)
        assert got == [r.result_id for r in wanted.orderBy(F.col("run_ts").desc(), F.col("result_id").desc()).limit(n).collect()]
        assert len(reads) == {(1, True): 1, (3, True): 1, (1, False): 3, (3, False): 4}.get((n, where is None), 5)     # 1, 2, 4, 8, 12 days
    listed = reports.run_history(store.newest(RESULTS, 2), NOW + timedelta(hours=1), limit=2)
    assert [r.result_id for r in listed.collect()] == [r.result_id for r in store.newest(RESULTS, 2).collect()]
    assert Store(store.spark, store.root + "-none").newest(RESULTS, 5).count() == 0
