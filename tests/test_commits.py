"""Several writers, jobs that die half-way, and the table of newest results."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts
from plumbline.operators.scoring import latest_results, previous_results
from plumbline.plans import workflow
from plumbline.sources import tables
from plumbline.sources.commits import CommitLog, Version
from plumbline.sources.registry import Registry
from plumbline.sources.tables import ALERT_HISTORY, NEWEST_RESULTS, POLICIES, RESULTS, RULES, SETTINGS, Store, newest_two
from tests.test_scoring import NOW, frame, result


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rule(name, **kw):
    return dict(rule_name=name, database_name="D", schema_name="S", table_name="T", column_name="c", rule_type="NOT_NULL", **kw)


class Dies(Exception):
    pass


def test_a_number_is_given_to_one_writer(spark, tmp_path):
    one, two = CommitLog(spark, str(tmp_path / "t")), CommitLog(spark, str(tmp_path / "t"))
    assert one.current() == Version()
    assert one.publish(Version(), "a", rows=3) and not two.publish(Version(), "b", rows=2)
    assert two.publish(two.current(), "b", rows=2)
    assert two.current() == Version(2, (("a", 1, 0), ("b", 2, 3)), 5, {}, 1)
    assert one.publish(one.current(), "c", snapshot=True)
    assert two.current() == Version(3, (("c", 3, 0),), 5, {}, 0)
    assert not [p for p in (tmp_path / "t" / "_commits").iterdir() if p.name.startswith("_")]     # what was aside is gone


def test_interleaved_writers_lose_nothing(store, monkeypatch):
    """Before each commit of the first writer another one commits: an insert, an edit of the same row, a delete."""
    other = Store(store.spark, store.root)
    store.insert(RULES, [rule("a"), rule("b"), rule("c")], as_of=NOW)
    publish, steps = CommitLog.publish, []

    def interrupted(self, *arguments, **options):
        if steps:
            step = steps.pop()
            step()
        return publish(self, *arguments, **options)

    monkeypatch.setattr(CommitLog, "publish", interrupted)
    steps.append(lambda: other.insert(RULES, [rule("theirs")], as_of=NOW))
    assert store.insert(RULES, [rule("mine"), rule("mine too")], as_of=NOW) == [5, 6]
    steps.append(lambda: other.update(RULES, other.rows(RULES).where("rule_id = 1").withColumn("severity", F.lit("LOW")), as_of=NOW, columns=("severity",)))
    edited = store.rows(RULES).where("rule_id <= 2").withColumn("threshold_pct", F.lit(9.0))
    assert store.update(RULES, edited, as_of=NOW, columns=("threshold_pct",)) == 2
    steps.append(lambda: other.delete(RULES, [2]))
    assert store.update(RULES, edited.withColumn("owner", F.lit("x")), as_of=NOW, columns=("owner",)) == 1
    steps.append(lambda: other.insert(RULES, [rule("late")], as_of=NOW))
    store.compact(RULES)
    steps.append(lambda: other.set_settings({"k": "theirs"}, as_of=NOW))
    store.set_settings({"k": "mine", "l": "mine"}, as_of=NOW, insert_only=True)
    got = {r.rule_id: (r.rule_name, r.severity, r.threshold_pct, r.owner) for r in store.rows(RULES).collect()}
    assert got == {1: ("a", "LOW", 9.0, "x"), 3: ("c", "MEDIUM", 0.0, None), 4: ("theirs", "MEDIUM", 0.0, None),
                   5: ("mine", "MEDIUM", 0.0, None), 6: ("mine too", "MEDIUM", 0.0, None), 7: ("late", "MEDIUM", 0.0, None)}
    assert {r.setting_key: r.setting_value for r in store.rows(SETTINGS).collect()} == {"k": "theirs", "l": "mine"}


@pytest.mark.parametrize("work", [
    lambda s: s.compact(RULES),
    lambda s: s.insert(RULES, [rule("new")], as_of=NOW),
    lambda s: s.update(RULES, s.rows(RULES).withColumn("owner", F.lit("x")), as_of=NOW, columns=("owner",)),
    lambda s: s.delete(RULES, [1]),
])
@pytest.mark.parametrize("moment", ["write", "publish"])
def test_a_dying_writer_changes_nothing(store, monkeypatch, work, moment):
    store.insert(RULES, [rule("a"), rule("b")], as_of=NOW)
    before = sorted(map(tuple, store.rows(RULES).collect()))
    proper = getattr(CommitLog, moment)

    def dies(self, *arguments, **options):
        if moment == "write":
            proper(self, *arguments, **options)
        raise Dies

    monkeypatch.setattr(CommitLog, moment, dies)
    with pytest.raises(Dies):
        work(store)
    monkeypatch.undo()
    assert sorted(map(tuple, store.rows(RULES).collect())) == before
    work(store)
    assert store.insert(RULES, [rule("c")], as_of=NOW)[0] >= 3


def test_a_frame_is_inserted_in_its_order_without_the_driver(store, monkeypatch):
    rows = store.spark.range(1000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("rule_name"),
                                          F.lit("UNIQUE").alias("rule_type")).repartition(7).orderBy("rule_name")
    ids = store.insert(RULES, rows, as_of=NOW)
    assert (len(ids), ids[0], ids[-1]) == (1000, 1, 1000)
    assert store.insert(RULES, rows.where("rule_name < 'r0010'"), as_of=NOW)[0] == 1001
    assert store.insert(RULES, rows.where("false"), as_of=NOW) == []
    got = store.rows(RULES)
    assert got.count() == got.select("rule_id").distinct().count() == 1010
    assert got.where("rule_id <= 1000 and rule_name <> concat('r', lpad(rule_id - 1, 4, '0'))").count() == 0
    store.delete(RULES, got.where("rule_id > 3"))
    assert sorted(r.rule_id for r in store.rows(RULES).collect()) == [1, 2, 3]


def test_a_frame_keeps_its_version(store):
    store.insert(RULES, [rule("a")], as_of=NOW)
    before = store.rows(RULES)
    store.update(RULES, before.withColumn("owner", F.lit("x")), as_of=NOW, columns=("owner",))
    store.delete(RULES, [1])
    store.compact(RULES)
    assert [r.owner for r in before.collect()] == [None] and store.rows(RULES).count() == 0


def test_long_logs_are_compacted(store, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT_AFTER", 3)
    for k in range(12):
        store.set_settings({f"k{k % 4}": str(k)}, as_of=NOW)
    version = store._log(SETTINGS).current()
    assert len(version.folders) <= 4 and version.since_snapshot <= 3
    assert {r.setting_key: r.setting_value for r in store.rows(SETTINGS).collect()} == {"k0": "8", "k1": "9", "k2": "10", "k3": "11"}
    fs, target = store._fs(store._path("settings"))
    assert len(fs.listStatus(target)) <= 12                       # folders of old commits are gone


# --- newest results

def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_newest_results_follow_appends(store):
    """Late results, ties, repeated rows, null moments; after each append equal to the whole history."""
    batches = [
        [result(1, "PASS", 3), result(2, "FAIL", 2), result(None, "PASS", 1)],
        [result(1, "FAIL", 1), result(1, "ERROR", 2), result(3, "PASS", 0)],
        [result(1, "PASS", 9), result(2, "PASS", 2, suffix="b"), result(2, "PASS", 2, suffix="b")],
        [result(4, "FAIL", day) for day in range(6)],
    ]
    columns = RESULTS.schema.names
    for rows in batches:
        store.append(RESULTS, frame(store.spark, *rows))
        assert same(store.newest_results().select(*columns), newest_two(store.read(RESULTS)).select(*columns))
    rules = store.spark.createDataFrame([(k, True, "o", "d") for k in range(1, 5)], "rule_id long, is_active boolean, owner string, description string")
    whole = store.read(RESULTS).select(*columns)
    assert same(latest_results(store.newest_results(), rules).select(*columns, "weight"), latest_results(whole, rules).select(*columns, "weight"))
    assert same(previous_results(store.newest_results()).select(*columns), previous_results(whole))
    kept = store.newest_results().collect()
    store.rebuild_newest_results()
    assert sorted(map(str, kept)) == sorted(map(str, store.newest_results().collect()))


def test_newest_results_after_retention(store):
    store.append(RESULTS, frame(store.spark, result(1, "PASS", 8), result(1, "FAIL", 1), result(2, "PASS", 9)))
    store.prune(RESULTS, NOW, 3)
    store.append(RESULTS, frame(store.spark, result(2, "FAIL", 20), result(3, "PASS", 0)))
    assert sorted((r.rule_id, r.status) for r in store.newest_results().collect()) == [(1, "FAIL"), (3, "PASS")]
    assert sorted(r.rule_id for r in store.read(RESULTS).collect()) == [1, 3]


@pytest.mark.parametrize("step", ["_append", "_settle"])
def test_newest_results_survive_a_dying_append(store, monkeypatch, step):
    store.append(RESULTS, frame(store.spark, result(1, "PASS", 3)))

    def dies(*_):
        raise Dies

    monkeypatch.setattr(Store, step, dies)
    with pytest.raises(Dies):
        store.append(RESULTS, frame(store.spark, result(1, "FAIL", 1)))
    monkeypatch.undo()
    expected = newest_two(store.read(RESULTS)).select(*RESULTS.schema.names)
    assert same(store.newest_results(), expected)                          # from the history
    store.append(RESULTS, frame(store.spark, result(2, "PASS", 1)))
    assert store._log(NEWEST_RESULTS).current().kept["open"] == []         # computed anew
    assert same(store.newest_results(), newest_two(store.read(RESULTS)).select(*RESULTS.schema.names))


def test_two_appends_at_once(store, monkeypatch):
    """Another append begins and ends while one is under way."""
    proper, other, done = Store._append, Store(store.spark, store.root), []

    def interrupted(self, log, rows):
        if not done:
            done.append(True)
            other.append(RESULTS, frame(store.spark, result(1, "FAIL", 0), result(2, "PASS", 2)))
        proper(self, log, rows)

    monkeypatch.setattr(Store, "_append", interrupted)
    store.append(RESULTS, frame(store.spark, result(1, "PASS", 1), result(1, "PASS", 2)))
    assert sorted((r.rule_id, r.status) for r in store.newest_results().collect()) == [(1, "FAIL"), (1, "PASS"), (2, "PASS")]


def test_evaluation_reads_no_history(store):
    """All inputs of an evaluation come from the newest results: no plan scans the history's folder."""
    store.insert(RULES, [rule("a", severity="CRITICAL"), rule("b")], as_of=NOW)
    store.insert(POLICIES, [dict(alert_name="p", channel_type="EMAIL", recipients="a@b.c", min_score=99.0, notify_mode="NEW_FAILURES_ONLY"),
                            dict(alert_name="q", channel_type="EMAIL", recipients="a@b.c", severity_filter="MEDIUM")], as_of=NOW)
    for day in (2, 1, 0):
        store.append(RESULTS, frame(store.spark, result(1, "FAIL" if day == 0 else "PASS", day), result(2, "FAIL", day)))
    chosen, rules = alerts.select_policies(store.rows(POLICIES)), store.rows(RULES)
    later = NOW + timedelta(hours=1)
    evaluated = alerts.evaluate_alerts(store.spark, store.newest_results(), rules, chosen, later)
    whole = alerts.evaluate_alerts(store.spark, store.read(RESULTS), rules, chosen, later)
    assert same(evaluated, whole)
    scanned = lambda rows: f"{store.root}/results" in rows._jdf.queryExecution().executedPlan().toString()
    assert scanned(whole) and not scanned(evaluated) and not scanned(latest_results(store.newest_results(), rules))


def test_last_evaluation_opens_the_newest_days_only(store):
    moment = ALERT_HISTORY.schema.names.index(ALERT_HISTORY.moment)
    for day in (0, 1, 5, 9):
        row = [None] * len(ALERT_HISTORY.schema)
        row[moment] = NOW - timedelta(days=day)
        store.append(ALERT_HISTORY, store.spark.createDataFrame([tuple(row)], ALERT_HISTORY.schema))
    rows = workflow.last_evaluation(store)
    assert [(r.n, r["at"]) for r in rows.collect()] == [(1, NOW)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "PartitionFilters: []" not in plan
    assert store.newest_days(ALERT_HISTORY).count() == 2
    assert workflow.last_evaluation(Store(store.spark, store.root + "-none")).count() == 0


def test_pruning_that_dies_is_repeated(store, monkeypatch):
    store.append(RESULTS, frame(store.spark, *[result(k, "PASS", k) for k in range(8)]))

    def dies(*_):
        raise Dies

    monkeypatch.setattr(Store, "_days", dies)
    with pytest.raises(Dies):
        store.prune(RESULTS, NOW, 3)
    monkeypatch.undo()
    kept = sorted(r.rule_id for r in store.read(RESULTS).collect())
    assert kept == [0, 1, 2, 3]                                            # the cutoff counts already
    store.prune(RESULTS, NOW, 3)
    assert sorted(r.rule_id for r in store.read(RESULTS).collect()) == kept and len(store._days(RESULTS)) == 4
    store.prune(RESULTS, NOW, 30)                                          # a longer period brings nothing back
    assert store.read(RESULTS).count() == 4


def test_suggestions_of_several_tables_run_at_once(store, monkeypatch):
    known, runs = Registry(store.spark), []
    for name in ("A", "B"):
        known.register(f"D.S.{name}", store.spark.range(10).toDF("n"))
    store.insert(RULES, [rule("old", ) | {"table_name": "A", "column_name": "n"}, rule("elsewhere")], as_of=NOW)
    suggested = store.spark.createDataFrame(
        [(f"{t} n not null", "d", t, "n", "NOT_NULL", "{}", 0.0, "HIGH") for t in ("A", "B")],
        "rule_name string, description string, table_name string, column_name string, rule_type string, rule_params string, threshold_pct double, severity string")
    proper = workflow.run_checks
    monkeypatch.setattr(workflow, "run_checks", lambda *a, **k: runs.append(1) or proper(*a, **k))
    totals = workflow.apply_suggestions(store, known, suggested, "D", "S", as_of=NOW)
    assert totals == {"rules": 2, "tables": 2, "PASS": 3, "FAIL": 0, "ERROR": 0} and len(runs) == 1
    assert store.read(RESULTS).count() == 3
    assert workflow.apply_suggestions(store, known, suggested.where("false"), "D", "S", as_of=NOW)["rules"] == 0
