"""Jobs over a store: run and record, import rules, apply suggestions, evaluate alerts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import alerts
from plumbline.operators.suggest import to_catalog_rows
from plumbline.plans.engine import run_checks
from plumbline.sources.csv import import_rules
from plumbline.sources.registry import Registry
from plumbline.sources.tables import ALERT_HISTORY, POLICIES, RESULTS, RULES, Store


def run_and_record(store: Store, registry: Registry, *, as_of: datetime, table: str | None = None,
                   rule_id: int | None = None, triggered_by: str = "MANUAL") -> DataFrame:
    """Run active rules of the catalog and append the results to the history."""
    results = run_checks(store.spark, store.rows(RULES), registry, table=table, rule_id=rule_id,
                         triggered_by=triggered_by, as_of=as_of)
    store.append(RESULTS, results)
    return results


def import_into_catalog(store: Store, path: str, *, as_of: datetime) -> Sequence[int]:
    """Add the rules of CSV files to the catalog, on the executors; nothing is added if any row is
    refused. Returns the new ids. Imported rules are active."""
    return store.insert(RULES, import_rules(store.spark, path), as_of=as_of)


def apply_suggestions(store: Store, registry: Registry, suggestions: DataFrame, database: str, schema: str, *,
                      as_of: datetime, owner: str | None = None, row_filter: str | None = None,
                      run: bool = True) -> dict[str, int]:
    """Add suggested rules to the catalog, and run all rules of the touched tables in one fused run."""
    ids = store.insert(RULES, to_catalog_rows(suggestions, database, schema, owner, row_filter), as_of=as_of)
    catalog = store.rows(RULES)
    fqn = F.upper(F.concat_ws(".", "database_name", "schema_name", "table_name"))
    added = catalog.where(F.col("rule_id").between(ids[0], ids[-1]) if ids else F.lit(False))
    touched = added.select(fqn.alias("touched")).distinct()
    totals = {"rules": len(ids), "tables": touched.count(), "PASS": 0, "FAIL": 0, "ERROR": 0}
    if run and ids:
        rules = catalog.join(touched, fqn == F.col("touched"), "left_semi")
        results = run_checks(store.spark, rules, registry, as_of=as_of)
        store.append(RESULTS, results)
        totals |= {row["status"]: row["count"] for row in results.groupBy("status").count().collect()}
    return totals


def notify(store: Store, *, as_of: datetime, alert_id: int | None = None, test: bool = False) -> DataFrame | None:
    """Evaluate alert policies against the newest results and log one row per policy; no day of the history
    is read. Returns the rows that were logged: evaluated once, a row per policy, whatever the store does next."""
    policies = alerts.select_policies(store.rows(POLICIES), alert_id)
    if not policies:
        return None
    evaluated = alerts.evaluate_alerts(
        store.spark, store.newest_results(), store.rows(RULES), policies, as_of,
        app_url=(store.setting("APP_URL") or "").strip(), test=test)
    logged = store.spark.createDataFrame(evaluated.collect(), evaluated.schema)
    store.append(ALERT_HISTORY, alerts.to_history(logged))
    return logged


def last_evaluation(store: Store) -> DataFrame:
    """Counts per status of the newest evaluation; of the log, two day folders at most are read."""
    return alerts.last_evaluation(store.newest_days(ALERT_HISTORY).drop(ALERT_HISTORY.partition))
