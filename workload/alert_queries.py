"""Alert policies, notification history and metric series over the projected history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from plumbline.model import ALERT_POLICIES_SCHEMA, SETTINGS_SCHEMA
from plumbline.operators import alerts, metrics, scoring
from plumbline.plans.workflow import last_evaluation
from plumbline.sources.tables import ALERT_HISTORY, Store
from plumbline.sources.workspace import work_folder
from workload.base import (
    AS_OF, AS_OF_SQL, DATABASE, MONITORED, SCHEMA, _pick, _pick_sql, catalog, history, read, with_inputs,
)
from workload.check_queries import O_OPEN
from workload.history_queries import results_in_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


# -- policies (configuration) -----------------------------------------------------------------------

# (id, channel, severities, minimum score, mode, scope, enabled)
POLICIES = (
    (1, "EMAIL", None, None, None, None, True),
    (2, "WEBHOOK", "CRITICAL", None, "ALL_FAILURES", "lake.retail.o*, LAKE.RETAIL.CUSTOMERS", True),
    (3, "EMAIL", "MEDIUM, low", None, "NEW_FAILURES_ONLY", "", True),
    (4, "SMS", "LOW", 60.0, "ALL_FAILURES", None, True),
    (5, "EMAIL", "INFO", None, "ALL_FAILURES", "NOWHERE.*", True),
    (6, "EMAIL", "CRITICAL", None, "ALL_FAILURES", None, False),
    (7, "WEBHOOK", "", 101.0, "ALL_FAILURES", "*.RETAIL.?*[SY]", True),
    (8, "WEBHOOK", "HIGH", None, "NEW_FAILURES_ONLY", "LAKE_RETAIL.*", True),
)


def policies(spark: SparkSession) -> list[Row]:
    rows = [(i, f"policy {i}", channel, "team@example.com", severities, score, on, None, None, mode, scope)
            for i, channel, severities, score, mode, scope, on in POLICIES]
    frame = spark.createDataFrame(rows, ALERT_POLICIES_SCHEMA)
    return alerts.select_policies(frame)


def _latest(spark, sf_dir):
    return scoring.latest_results(history(spark, sf_dir), catalog(spark, sf_dir))


def _matched(test: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = history(spark, sf_dir)
        failures = alerts.current_failures(results, catalog(spark, sf_dir), AS_OF, test)
        return alerts.matched_failures(failures, results, policies(spark), test).select(
            "alert_id", "rule_id", "table_fqn", "severity", "status", "failed_pct")
    return query


def _low(spark, sf_dir):
    return alerts.low_score_tables(scoring.table_health(_latest(spark, sf_dir)), policies(spark))


def _evaluate(test: bool, url: str = ""):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alerts.evaluate_alerts(spark, history(spark, sf_dir), catalog(spark, sf_dir), policies(spark), AS_OF,
                                      app_url=url, test=test).drop("history_id")
    return query


# -- the same as SQL ----------------------------------------------------------------------------------


def _policy_values() -> str:
    rows = []
    for number, channel, severities, score, mode, scope, on in POLICIES:
        if on:
            listed = [s.strip().upper() for s in (severities or "CRITICAL,HIGH").split(",")]
            globs = [g.strip().upper() for g in (scope or "*").split(",") if g.strip()] or ["*"]
            new = "true" if mode == "NEW_FAILURES_ONLY" else "false"
            rows.append(f"({number}::BIGINT, '{channel}', {listed}, {globs}, {new}, {score if score else 'NULL'}::DOUBLE)")
    return ("policies(alert_id, channel, severities, globs, new_only, min_score) AS (VALUES " + ", ".join(rows) + ")")


_IN_SCOPE = "len(list_filter(globs, lambda g: upper(table_fqn) GLOB g)) > 0"


def _matched_cte(test: bool) -> str:
    window = "" if test else " AND l.run_ts > TIMESTAMP '2024-01-30 18:00:00'"
    fresh = "" if test else " AND (NOT new_only OR p.status IS NULL OR p.status = 'PASS')"
    return (f", {_policy_values()}, matched AS (SELECT alert_id, l.*, p.status AS previous_status FROM latest l "
            f"LEFT JOIN previous p ON p.rule_id = l.rule_id, policies WHERE l.status <> 'PASS'{window} "
            f"AND list_contains(severities, l.severity) AND {_IN_SCOPE.replace('table_fqn', 'l.table_fqn')}{fresh}), "
            f"low AS (SELECT table_fqn, dq_score, alert_id FROM health, policies "
            f"WHERE dq_score < min_score AND {_IN_SCOPE})")


def _with_matched(sql: str, test: bool) -> str:
    return with_inputs("", "latest", "previous", "health").rstrip() + _matched_cte(test) + " " + sql


_PCT = "coalesce(printf('%.2f', {0}) || '%', '-')"


def _messages(test: bool, url: str = "") -> str:
    prefix = "[TEST] " if test else ""
    link = f"|| chr(10) || 'Open the app: {url}'" if url else ""
    line = ("'- [' || severity || '] ' || rule_name || ' on ' || table_fqn || ': ' || " + _PCT.format("failed_pct")
            + " || ' failed (threshold ' || " + _PCT.format("threshold_pct") + " || ')'")
    rank = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"
    return _with_matched(f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY {rank}, table_fqn, rule_name, rule_id) AS rn FROM matched),
told AS (SELECT alert_id, count(*) AS n, string_agg({line}, chr(10) ORDER BY rn) FILTER (rn <= 25) AS lines,
                array_to_string(list_sort(list(DISTINCT table_fqn)), ', ') AS tables FROM ranked GROUP BY alert_id),
lows AS (SELECT alert_id, string_agg(table_fqn || ' (' || printf('%.1f', dq_score) || ')', ', ' ORDER BY table_fqn) AS low
         FROM low GROUP BY alert_id),
shown AS (SELECT p.*, coalesce(n, 0) AS n, tables, low, n IS NULL AND low IS NULL AS nothing,
                 '{prefix}Data Quality Alert: ' || coalesce(n, 0) || ' check(s) failed' || coalesce(chr(10) || lines, '')
                 || CASE WHEN n > 25 THEN chr(10) || '... and ' || (n - 25) || ' more' ELSE '' END
                 || coalesce(chr(10) || 'Tables below score ' || printf('%.0f', min_score) || ': ' || low, '') {link} AS message
          FROM policies p LEFT JOIN told USING (alert_id) LEFT JOIN lows USING (alert_id))
SELECT alert_id, 'policy ' || alert_id AS alert_name, channel AS channel_type, 'team@example.com' AS recipients,
       n AS failures_count, CASE WHEN NOT nothing THEN coalesce(tables, '') END AS tables_affected,
       CASE WHEN NOT nothing THEN message WHEN new_only THEN 'No new failures since previous run'
            ELSE 'No matching failures' END AS message_preview,
       CASE WHEN nothing THEN 'SKIPPED' WHEN channel IN ('EMAIL', 'WEBHOOK') THEN 'READY' ELSE 'FAILED' END AS status,
       CASE WHEN NOT nothing AND channel NOT IN ('EMAIL', 'WEBHOOK') THEN 'Unknown channel type: ' || channel END AS error_message,
       {AS_OF_SQL} AS sent_at, CASE WHEN NOT nothing THEN message END AS message
FROM shown""".lstrip(), test).replace(" ,\nranked", ",\nranked")


_MATCHED = "SELECT alert_id, rule_id, table_fqn, severity, status, failed_pct FROM matched"
_register("alert_failures", _matched(True), _with_matched(_MATCHED, True))
_register("alert_new_failures", _matched(False), _with_matched(_MATCHED, False))
_register("alert_low_score", _low, _with_matched("SELECT alert_id, table_fqn, dq_score FROM low", False))
_register("alert_messages", _evaluate(False, "https://dq.example.com"), _messages(False, "https://dq.example.com"))
_register("alert_messages_test", _evaluate(True), _messages(True))


def _evaluate_store(spark, sf_dir):
    """Evaluated over a store: the newest results of every rule, no day of the history."""
    store = results_in_batches(spark, sf_dir)
    return alerts.evaluate_alerts(spark, store.newest_results(), catalog(spark, sf_dir), policies(spark), AS_OF,
                                  app_url="https://dq.example.com").drop("history_id")


_register("alert_messages_store", _evaluate_store, _messages(False, "https://dq.example.com"))
_register("alert_summary", lambda s, d: alerts.evaluation_summary(_evaluate(False)(s, d)),
          f"SELECT status, count(*) AS n FROM ({_messages(False)}) GROUP BY status")


def _one_policy(spark, sf_dir):
    rows = [(i, f"policy {i}", c, "x", sev, score, on, None, None, mode, scope) for i, c, sev, score, mode, scope, on in POLICIES]
    chosen = alerts.select_policies(spark.createDataFrame(rows, ALERT_POLICIES_SCHEMA), alert_id=6)
    results = history(spark, sf_dir)
    failures = alerts.current_failures(results, catalog(spark, sf_dir), AS_OF, True)
    return alerts.matched_failures(failures, results, chosen, True).select(
        "alert_id", "rule_id", "severity")


_register("alert_test_policy", _one_policy, with_inputs(
    "SELECT 6::BIGINT AS alert_id, rule_id, severity FROM latest WHERE status <> 'PASS' AND severity = 'CRITICAL'", "latest"))

# -- many policies: one per customer ---------------------------------------------------------------------

_SCOPE_OF = (None, "LAKE.RETAIL.*", "lake.retail.o*, *.PAYMENTS", "*.RETAIL.?*[SY]", "LAKE.RETAIL.STORES,LAKE.RETAIL.RETURNS", "LAKE.OTHER.*", "*")
_LISTED_OF = ("CRITICAL", "MEDIUM,LOW", None, "HIGH", "INFO")


def customers_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, severities, minimum score and mode follow from the customer's keys."""
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("alert_id"), F.concat(F.lit("policy "), F.col("c_custkey").cast("string")).alias("alert_name"),
        F.lit("EMAIL").alias("channel_type"), F.lit("team@example.com").alias("recipients"),
        _pick(_LISTED_OF, "c_custkey % 5").alias("severity_filter"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 40.0D + c_nationkey END").alias("min_score"),
        (F.col("c_acctbal") >= 0).alias("is_enabled"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        F.when(F.col("c_custkey") % 4 == 0, "NEW_FAILURES_ONLY").alias("notify_mode"), _pick(_SCOPE_OF, "c_custkey % 7").alias("scope_tables"))
    return alerts.policy_frame(rows)


def _many_failures(spark, sf_dir):
    results, rules = history(spark, sf_dir), catalog(spark, sf_dir)
    failures = alerts.current_failures(results, rules, AS_OF)
    return alerts.matched_failures(failures, results, customers_policies(spark, sf_dir)).select("alert_id", "rule_id", "table_fqn", "severity")


_GLOBS = "[" + ", ".join(str([g.strip().upper() for g in (s or "*").split(",")]) for s in _SCOPE_OF) + "]"
_MANY = (", policies AS (SELECT c_custkey AS alert_id, string_split(coalesce(" + _pick_sql(_LISTED_OF, "c_custkey % 5") + ", 'CRITICAL,HIGH'), ',') AS severities, "
         f"({_GLOBS})[c_custkey % 7 + 1] AS globs, c_custkey % 4 = 0 AS new_only, CASE WHEN c_custkey % 3 = 0 THEN 40.0 + c_nationkey END AS min_score "
         "FROM customer WHERE c_acctbal >= 0) ")
_register("alert_many_policies", _many_failures, with_inputs("", "latest", "previous").rstrip() + _MANY + (
    "SELECT alert_id, l.rule_id, l.table_fqn, l.severity FROM latest l LEFT JOIN previous p ON p.rule_id = l.rule_id, policies "
    "WHERE l.status <> 'PASS' AND l.run_ts > TIMESTAMP '2024-01-30 18:00:00' AND list_contains(severities, l.severity) "
    f"AND {_IN_SCOPE.replace('table_fqn', 'l.table_fqn')} AND (NOT new_only OR p.status IS NULL OR p.status = 'PASS')"))
_register("alert_many_low_scores",
          lambda s, d: alerts.low_score_tables(scoring.table_health(_latest(s, d)), customers_policies(s, d)),
          with_inputs("", "health").rstrip() + _MANY + f"SELECT alert_id, table_fqn, dq_score FROM health, policies WHERE dq_score < min_score AND {_IN_SCOPE}")

# -- notification history: every event is one notification ---------------------------------------------


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("history_id"), (F.col("user_id") % 10).alias("alert_id"),
        F.concat(F.lit("policy "), (F.col("user_id") % 10).cast("string")).alias("alert_name"),
        F.lit("EMAIL").alias("channel_type"), F.lit("team@example.com").alias("recipients"),
        (F.col("event_id") % 7).alias("failures_count"), F.lit(None).cast("string").alias("tables_affected"),
        F.col("props").alias("message_preview"),
        F.when(kind == "error", "FAILED").when(kind == "view", "SKIPPED").when(kind == "click", "READY").otherwise("SENT").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("sent_at"),
    )


_NOTIFICATIONS = (
    "(SELECT lpad(event_id::VARCHAR, 12, '0') AS history_id, user_id % 10 AS alert_id, 'policy ' || user_id % 10 AS alert_name, "
    "event_id % 7 AS failures_count, props AS message_preview, CASE event_type WHEN 'error' THEN 'FAILED' "
    "WHEN 'view' THEN 'SKIPPED' WHEN 'click' THEN 'READY' ELSE 'SENT' END AS status, ts AS sent_at FROM events)")
_register("notification_history",
          lambda s, d: alerts.notification_history(notifications(s, d), ("policy 1", "policy 2", "policy 3"), ("SENT", "FAILED")).select(
              "history_id", "sent_at", "alert_id", "status", "failures_count", "message_preview"),
          f"SELECT history_id, sent_at, alert_id, status, failures_count, message_preview FROM {_NOTIFICATIONS} "
          "WHERE alert_name IN ('policy 1', 'policy 2', 'policy 3') AND status IN ('SENT', 'FAILED')")
_register("notification_kpis", lambda s, d: alerts.notification_kpis(notifications(s, d)),
          "SELECT count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'SENT') AS sent, "
          "count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped, "
          f"max(sent_at) AS latest FROM {_NOTIFICATIONS}")
_register("last_evaluation", lambda s, d: alerts.last_evaluation(notifications(s, d)),
          f"SELECT status, count(*) AS n, max(sent_at) AS at FROM {_NOTIFICATIONS} "
          "WHERE sent_at >= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events) GROUP BY status")


def _settings(spark: SparkSession, value: str) -> DataFrame:
    return spark.createDataFrame([("APP_URL", "", None), ("ALERT_HISTORY_RETENTION_DAYS", value, None)], SETTINGS_SCHEMA)


_register("alert_retention",
          lambda s, d: alerts.retained_history(notifications(s, d), _settings(s, "12"), AS_OF).select("history_id", "status"),
          f"SELECT history_id, status FROM {_NOTIFICATIONS} WHERE sent_at >= TIMESTAMP '2024-01-19 00:00:00'")
_register("alert_retention_default",
          lambda s, d: alerts.retained_history(notifications(s, d), _settings(s, "soon"), AS_OF.replace(month=4, day=10)).select(
              "history_id", "status"),
          f"SELECT history_id, status FROM {_NOTIFICATIONS} WHERE sent_at >= TIMESTAMP '2024-01-11 00:00:00'")


def _retained_store(spark, sf_dir):
    """The same retention as files: expired days are dropped, the rest of the boundary day stays out."""
    store = Store(spark, work_folder(spark, "alerts"))
    clock = AS_OF.replace(hour=6, minute=30)
    store.set_settings({"ALERT_HISTORY_RETENTION_DAYS": "5"}, as_of=clock)
    store.append(ALERT_HISTORY, notifications(spark, sf_dir))
    store.apply_alert_retention(clock)
    return store.read(ALERT_HISTORY).select("history_id", "status", "sent_date")


def _last_of_store(spark, sf_dir):
    store = Store(spark, work_folder(spark, "alerts"))
    store.append(ALERT_HISTORY, notifications(spark, sf_dir))
    return last_evaluation(store)


_register("last_evaluation_store", _last_of_store, ORACLE["last_evaluation"])
_register("alert_retention_store", _retained_store,
          f"SELECT history_id, status, sent_at::DATE AS sent_date FROM {_NOTIFICATIONS} "
          "WHERE sent_at >= TIMESTAMP '2024-01-26 06:30:00'")

# -- policy validation: every supplier is one policy ----------------------------------------------------

_ADDRESS = "lower(replace(s_name, '#', ''))"
_CASES = (f"CASE WHEN s_suppkey % 5 = 0 THEN {_ADDRESS} || '@example.com, broken@' || s_nationkey "
          f"WHEN s_suppkey % 5 = 1 THEN {_ADDRESS} || '@mail.net' WHEN s_suppkey % 5 = 2 THEN '' "
          f"ELSE 'team@example.com,' || {_ADDRESS} || '@example.com' END")
_SEVERITIES = "CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'CRITICAL,HIGH' END"
_SCORE = "CASE WHEN s_acctbal > 5000 THEN 80.0 END"


def _problems(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("alert_id"), F.col("s_name").alias("alert_name"),
        F.when(F.col("s_suppkey") % 7 == 0, "WEBHOOK").otherwise("EMAIL").alias("channel_type"),
        F.expr(_CASES).alias("recipients"), F.expr(_SEVERITIES).alias("severity_filter"), F.expr(_SCORE).alias("min_score"))
    return alerts.policy_problems(rows, allowed=["team@example.com"])


_register("policy_problems", _problems, f"""
WITH p AS (SELECT s_suppkey AS alert_id, s_name AS alert_name, CASE WHEN s_suppkey % 7 = 0 THEN 'WEBHOOK' ELSE 'EMAIL' END AS channel,
                  {_CASES} AS recipients, {_SEVERITIES} AS severities, {_SCORE} AS min_score FROM supplier),
a AS (SELECT *, list_filter(list_transform(string_split(recipients, ','), lambda x: trim(x)), lambda x: x <> '') AS addresses FROM p),
m AS (SELECT *, list_filter(addresses, lambda x: channel = 'EMAIL' AND NOT regexp_matches(x, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS malformed,
             list_filter(addresses, lambda x: channel = 'EMAIL' AND regexp_matches(x, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
                                              AND x <> 'team@example.com') AS not_allowed FROM a),
q AS (SELECT *, concat_ws('; ', CASE WHEN len(malformed) > 0 THEN 'fix malformed addresses: ' || array_to_string(malformed, ', ') END,
             CASE WHEN recipients = '' THEN 'set recipients' END,
             CASE WHEN coalesce(severities, '') = '' AND min_score IS NULL THEN 'pick a severity or a score threshold' END) AS problems FROM m)
SELECT alert_id, malformed, not_allowed, problems, problems = '' AS is_valid FROM q""")
_register("scope_options", lambda s, d: alerts.scope_options(catalog(s, d)),
          with_inputs("SELECT DISTINCT database_name || '.' || schema_name || '.' || table_name AS scope FROM rules "
                      "UNION SELECT database_name || '.' || schema_name || '.*' FROM rules", "rules"))

# -- metrics ----------------------------------------------------------------------------------------------


def _measured(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))).withColumn(
        "o_custkey", F.when(F.col("o_orderpriority").isNotNull(), F.col("o_custkey")))
    return metrics.measure_table(
        orders, "LAKE.RETAIL.ORDERS", as_of=AS_OF, null_count=("o_custkey", "o_orderpriority"),
        duplicate_count=("o_custkey", ("o_custkey", "o_orderstatus")), freshness=("o_orderdate",))


_MEASURE = ("SELECT {0} AS measured_at, 'LAKE.RETAIL.ORDERS' AS table_fqn, '{1}' AS metric, {2} AS arguments, "
            "({3})::DOUBLE AS value FROM " + O_OPEN)
_register("metric_measure", _measured, " UNION ALL ".join([
    _MEASURE.format(AS_OF_SQL, "ROW_COUNT", "NULL::VARCHAR", "count(*)"),
    _MEASURE.format(AS_OF_SQL, "NULL_COUNT", "'o_custkey'", "count(*) FILTER (o_custkey IS NULL)"),
    _MEASURE.format(AS_OF_SQL, "NULL_COUNT", "'o_orderpriority'", "count(*) FILTER (o_orderpriority IS NULL)"),
    _MEASURE.format(AS_OF_SQL, "FRESHNESS", "'o_orderdate'", f"date_diff('minute', max(o_orderdate), {AS_OF_SQL})"),
    _MEASURE.format(AS_OF_SQL, "DUPLICATE_COUNT", "'o_custkey'", "count(*) - count(DISTINCT coalesce(o_custkey, -1))"),
    _MEASURE.format(AS_OF_SQL, "DUPLICATE_COUNT", "'o_custkey, o_orderstatus'",
                    "count(*) - count(DISTINCT (coalesce(o_custkey, -1), o_orderstatus))"),
]))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("measured_at"),
        F.concat(F.lit(f"{DATABASE}.{SCHEMA}."), _pick(MONITORED, "user_id % 8")).alias("table_fqn"),
        F.concat(F.lit("CORE."), F.upper("event_type")).alias("metric"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string"))).alias("arguments"),
        "value",
    )


_MEASURED = (
    f"(SELECT ts AS measured_at, '{DATABASE}.{SCHEMA}.' || {_pick_sql(MONITORED, 'user_id % 8')} AS table_fqn, "
    "'CORE.' || upper(event_type) AS metric, CASE WHEN user_id % 3 > 0 THEN 'C' || user_id % 3 END AS arguments, value "
    "FROM events WHERE ts >= TIMESTAMP '2024-01-24')")


def _recent(spark, sf_dir):
    return metrics.newest_measurements(measurements(spark, sf_dir), AS_OF, 7)


_LATEST_METRIC = (f"(SELECT * FROM {_MEASURED} QUALIFY row_number() OVER (PARTITION BY table_fqn, metric, arguments "
                  "ORDER BY measured_at DESC) = 1)")
_register("metric_latest", lambda s, d: metrics.latest_metrics(_recent(s, d)), f"SELECT * FROM {_LATEST_METRIC}")
_register("metric_series", lambda s, d: metrics.metric_series(_recent(s, d), "LAKE.RETAIL.ORDERS", "CORE.ERROR"),
          f"SELECT measured_at, value FROM {_MEASURED} WHERE table_fqn = 'LAKE.RETAIL.ORDERS' AND metric = 'CORE.ERROR' "
          "AND arguments IS NULL")


def _alarming(spark, sf_dir):
    newest = _recent(spark, sf_dir)
    return metrics.series_like(newest, metrics.latest_metrics(newest).where("value > 90"))


_register("metric_series_of_latest", _alarming,
          f"SELECT m.* FROM {_MEASURED} m WHERE EXISTS (SELECT 1 FROM {_LATEST_METRIC} l WHERE l.value > 90 "
          "AND l.table_fqn = m.table_fqn AND l.metric = m.metric AND l.arguments IS NOT DISTINCT FROM m.arguments)")
_register("metric_kpis", lambda s, d: metrics.metric_kpis(_recent(s, d)),
          "SELECT count(DISTINCT table_fqn) AS tables, count(DISTINCT (table_fqn, metric, coalesce(arguments, ''))) AS metrics, "
          f"count(*) AS measurements FROM {_MEASURED}")
