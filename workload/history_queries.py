"""Scoring views, dashboard datasets and the catalog over the projected history."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import reports, scoring
from plumbline.plans.workflow import import_into_catalog
from plumbline.sources.csv import export_results, export_rules, import_rules, normalise_rules
from plumbline.sources.registry import Registry
from plumbline.sources.tables import POLICIES, RESULTS, RULES, Store, changed_rows, delete_rows, merge_rows
from plumbline.sources.workspace import work_folder
from workload.base import (
    AS_OF, BAND_SQL, DATABASE, SCHEMA, SCORE_SQL, TABLE_COLUMNS, TABLES, catalog, history, read, registry, with_inputs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RESULT_COLUMNS = ("result_id", "run_ts", "rule_id", "table_fqn", "severity", "status", "failed_pct")
_RC = ", ".join(RESULT_COLUMNS)
ONE_TABLE = f"{DATABASE}.{SCHEMA}.ORDERS"


def _register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None, *inputs: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = with_inputs(sql, *inputs) if inputs else sql


def _latest(spark, sf_dir):
    return scoring.latest_results(history(spark, sf_dir), catalog(spark, sf_dir))


def _daily(spark, sf_dir):
    return scoring.daily_results(history(spark, sf_dir))


def _health(spark, sf_dir):
    return scoring.table_health(_latest(spark, sf_dir))


def _of(source, operator, *arguments, **options):
    """A query that applies one operator to one of the inputs above."""
    return lambda spark, sf_dir: operator(source(spark, sf_dir), *arguments, **options)


# -- scoring views ------------------------------------------------------------------------------

_register("latest_results", lambda s, d: _latest(s, d).select(*RESULT_COLUMNS, "weight", "owner", "description"),
          f"SELECT {_RC}, weight, owner, description FROM latest", "latest")
_register("daily_results", lambda s, d: _daily(s, d).select(*RESULT_COLUMNS, "run_date", "weight"),
          f"SELECT {_RC}, run_date, weight FROM daily", "daily")
_register("previous_results", lambda s, d: scoring.previous_results(history(s, d)).select(*RESULT_COLUMNS),
          f"SELECT {_RC} FROM previous", "previous")
_register("daily_table_score", _of(_daily, scoring.daily_table_score), "SELECT * FROM table_score", "table_score")
_register("table_health", _health, "SELECT * FROM health", "health")
_register("score_trend", _of(_daily, scoring.score_trend, AS_OF, 30), "SELECT * FROM trend", "trend")
_register("dimension_score", _of(_latest, scoring.dimension_score),
          f"SELECT dimension, count(rule_id) AS checks, {SCORE_SQL} AS dq_score FROM latest "
          "WHERE dimension IS NOT NULL GROUP BY dimension", "latest")
_register("custom_weights",
          lambda s, d: scoring.table_health(scoring.latest_results(
              history(s, d), catalog(s, d), {"CRITICAL": 10, "HIGH": 3, "LOW": 1})).select("table_fqn", "dq_score"),
          "SELECT table_fqn, " + SCORE_SQL.replace("weight", "w") + " AS dq_score FROM (SELECT *, CASE severity "
          "WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 END AS w FROM latest) GROUP BY table_fqn", "latest")

# -- overview -------------------------------------------------------------------------------------

_register(
    "overview_kpis", lambda s, d: reports.overview_kpis(_latest(s, d), _daily(s, d), AS_OF, 30),
    f"""SELECT *, checks - failing - errored AS passing,
           round(100 * (checks - failing - errored)::DOUBLE / nullif(checks, 0), 0) AS pass_rate,
           round(dq_score - previous_score, 1) AS score_delta, {BAND_SQL.format('dq_score')} AS band
    FROM (SELECT {SCORE_SQL} AS dq_score, count(*) AS checks, count(*) FILTER (status = 'FAIL') AS failing,
                 count(*) FILTER (status = 'ERROR') AS errored,
                 count(*) FILTER (status <> 'PASS' AND severity = 'CRITICAL') AS critical_issues,
                 count(DISTINCT table_fqn) AS tables_monitored, max(run_ts) AS last_run_ts,
                 (SELECT dq_score FROM trend ORDER BY run_date DESC LIMIT 1 OFFSET 1) AS previous_score
          FROM latest)""", "latest", "trend")
_register("status_mix", _of(_latest, reports.status_mix), "SELECT status, count(*) AS n FROM latest GROUP BY status", "latest")
_register("leaderboard", _of(_health, reports.leaderboard),
          f"SELECT table_fqn, dq_score, {BAND_SQL.format('dq_score')} AS band, checks, failed, errors, critical_issues, "
          "last_run_ts FROM health", "health")
_register("score_heatmap", _of(_daily, reports.score_heatmap, AS_OF, 14),
          "SELECT run_date, table_fqn, dq_score, checks, failed FROM table_score WHERE run_date >= DATE '2024-01-17'",
          "table_score")
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 END"
_register("open_issues", _of(_latest, reports.open_issues),
          f"SELECT rule_id, rule_name, table_fqn, column_name, rule_type, severity, {_RANK} AS severity_rank, status, "
          "failed_rows, failed_pct, threshold_pct, error_message FROM latest WHERE status <> 'PASS' "
          f"ORDER BY {_RANK} NULLS LAST, failed_pct DESC NULLS LAST, rule_id LIMIT 12", "latest")
_register("open_issue_counts", _of(_latest, reports.open_issue_counts),
          "SELECT count(*) FILTER (status <> 'PASS') AS open_issues, "
          "greatest(count(*) FILTER (status <> 'PASS') - 12, 0) AS not_shown FROM latest", "latest")

# -- one table --------------------------------------------------------------------------------------

_register("table_header", _of(_health, reports.table_header, ONE_TABLE),
          f"SELECT *, {BAND_SQL.format('dq_score')} AS band FROM health WHERE table_fqn = '{ONE_TABLE}'", "health")
_register("table_trend", _of(_daily, reports.table_trend, ONE_TABLE, AS_OF),
          f"SELECT run_date, dq_score FROM table_score WHERE table_fqn = '{ONE_TABLE}'", "table_score")
_register("table_checks", _of(_latest, reports.table_checks, ONE_TABLE),
          "SELECT rule_id, status, severity, rule_name, column_name, rule_type, dimension, failed_rows, total_rows, "
          f"failed_pct, threshold_pct, owner FROM latest WHERE table_fqn = '{ONE_TABLE}'", "latest")
_register("dimension_status", _of(_latest, reports.dimension_status),
          "SELECT dimension, status, count(*) AS n FROM latest WHERE dimension IS NOT NULL GROUP BY ALL", "latest")
_register("rule_failure_history", _of(_daily, reports.rule_failure_history, AS_OF),
          "SELECT rule_id, run_date, failed_pct, threshold_pct, status, failed_rows FROM daily "
          "WHERE run_date >= DATE '2023-11-02'", "daily")

# -- run history ------------------------------------------------------------------------------------


def _history(spark, sf_dir, **filters):
    return reports.run_history(history(spark, sf_dir), AS_OF, **filters)


_NEWEST = "(SELECT * FROM results WHERE run_ts >= TIMESTAMP '{0}' {1})"
_register("run_history", lambda s, d: _history(s, d, days=14, severities=("CRITICAL", "HIGH"), statuses=("FAIL", "ERROR"),
                                               triggers=("MANUAL", "SCHEDULE")),
          "SELECT * FROM " + _NEWEST.format("2024-01-17", "AND severity IN ('CRITICAL', 'HIGH') AND status IN "
                                            "('FAIL', 'ERROR') AND triggered_by IN ('MANUAL', 'SCHEDULE')"), "results")
_register("run_history_kpis", lambda s, d: reports.run_history_kpis(_history(s, d)),
          "SELECT count(*) AS executions, count(DISTINCT run_id) AS runs, "
          "round(100 * count(*) FILTER (status = 'PASS')::DOUBLE / count(*), 1) AS pass_rate, "
          "count(*) FILTER (status = 'FAIL') AS failures, count(*) FILTER (status = 'ERROR') AS errors, "
          "round(avg(duration_ms) / 1000, 2) AS avg_duration_s FROM " + _NEWEST.format("2024-01-01", ""), "results")
_register("executions_per_day", lambda s, d: reports.executions_per_day(_history(s, d)),
          "SELECT run_ts::DATE AS run_date, status, count(*) AS n FROM " + _NEWEST.format("2024-01-01", "")
          + " GROUP BY ALL", "results")


def _results_csv(spark, sf_dir):
    path = work_folder(spark, "results-csv")
    export_results(_history(spark, sf_dir), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("result_id", "rule_name", "table_fqn", "status", F.col("failed_rows").cast("long").alias("failed_rows"))


_register("results_csv", _results_csv, "SELECT result_id, rule_name, table_fqn, status, failed_rows FROM "
          + _NEWEST.format("2024-01-01", ""), "results")


def _stored(spark, sf_dir):
    """The history appended to a store day by day, read back through its day partitions."""
    store = Store(spark, work_folder(spark, "store"))
    store.append(RESULTS, history(spark, sf_dir))
    return store


_register("history_store", lambda s, d: scoring.score_trend(scoring.daily_results(_stored(s, d).read(RESULTS)), AS_OF, 30),
          "SELECT * FROM trend", "trend")


def _pruned(spark, sf_dir):
    store = _stored(spark, sf_dir)
    store.prune(RESULTS, AS_OF.replace(hour=7), 10)
    return store.read(RESULTS).select("result_id", "run_date", "status")


_register("history_prune", _pruned, "SELECT result_id, run_ts::DATE AS run_date, status FROM results "
          "WHERE run_ts >= TIMESTAMP '2024-01-21 07:00:00'", "results")

# -- catalog ------------------------------------------------------------------------------------------

_LISTED = ("SELECT r.rule_id, r.is_active, l.status AS last_status, r.rule_name, r.database_name || '.' || r.schema_name "
           "|| '.' || r.table_name AS table_fqn, r.column_name, r.rule_type, r.rule_params, r.row_filter, r.threshold_pct, "
           "r.severity, r.dimension, r.owner FROM rules r LEFT JOIN latest l ON l.rule_id = r.rule_id ")
_register("rule_listing", lambda s, d: reports.rule_listing(catalog(s, d), _latest(s, d)), _LISTED, "latest", "rules")
_register("rule_catalog_search",
          lambda s, d: reports.rule_listing(catalog(s, d), _latest(s, d), tables=(ONE_TABLE, f"{DATABASE}.{SCHEMA}.RETURNS"),
                                            types=("REGEX", "RANGE", "UNIQUE"), text="BUILD"),
          _LISTED + "WHERE r.database_name || '.' || r.schema_name || '.' || r.table_name IN "
          f"('{ONE_TABLE}', '{DATABASE}.{SCHEMA}.RETURNS') AND r.rule_type IN "
          "('REGEX', 'RANGE', 'UNIQUE') AND contains(lower(concat_ws(' ', coalesce(r.rule_name, ''), "
          "coalesce(r.column_name, ''), coalesce(r.owner, ''), coalesce(r.description, ''))), 'build')", "latest", "rules")
_register("catalog_kpis", _of(catalog, reports.catalog_kpis),
          "SELECT count(*) AS rules, count(*) FILTER (is_active) AS active, count(DISTINCT database_name || '.' || "
          "schema_name || '.' || table_name) AS tables_covered, count(DISTINCT rule_type) AS rule_types_used, "
          "count(DISTINCT owner) AS owners FROM rules", "rules")
_register("existing_rules", lambda s, d: reports.existing_rules(catalog(s, d), _latest(s, d), DATABASE, SCHEMA, True),
          "SELECT r.rule_id, r.table_name, r.rule_name, r.column_name, r.rule_type, r.severity, r.is_active, "
          "l.status AS last_status, l.failed_pct, l.run_ts FROM rules r LEFT JOIN latest l ON l.rule_id = r.rule_id "
          "WHERE r.is_active", "latest", "rules")


# Coverage of the given tables: each customer becomes a rule on one column of one table.
_COVERED = (("orders", "O_ORDERKEY"), ("orders", "o_custkey"), ("customer", "C_ACCTBAL"), ("nation", "n_name"),
            ("lineitem", "l_orderkey,l_linenumber"), ("lineitem", "l_tax"), ("part", None))


def _given_rules(spark, sf_dir):
    names = ", ".join(f"'{t}'" for t, _ in _COVERED)
    columns = ", ".join("NULL" if c is None else f"'{c}'" for _, c in _COVERED)
    rules = catalog(spark, sf_dir)
    return rules.withColumn("table_name", F.expr(f"get(array({names}), CAST(rule_id % {len(_COVERED)} AS INT))")).withColumn(
        "column_name", F.expr(f"get(array({columns}), CAST(rule_id % {len(_COVERED)} AS INT))"))


def _given_health(spark, sf_dir):
    rules = _given_rules(spark, sf_dir).select("rule_id", "table_name")
    named = _latest(spark, sf_dir).join(rules, "rule_id").withColumn(
        "table_fqn", F.concat(F.lit(f"{DATABASE}.{SCHEMA}."), F.upper("table_name")))
    return scoring.table_health(named)


_GIVEN = ("given AS (SELECT * REPLACE (([" + ", ".join(f"'{t}'" for t, _ in _COVERED) + f"])[(rule_id % {len(_COVERED)}) + 1] "
          "AS table_name, ([" + ", ".join("NULL" if c is None else f"'{c}'" for _, c in _COVERED)
          + f"])[(rule_id % {len(_COVERED)}) + 1] AS column_name) FROM rules)")
_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_COVERAGE = (
    ", " + _GIVEN + ", widths AS (SELECT table_name, count(*) AS n_cols FROM information_schema.columns "
    f"WHERE table_name IN ({_NAMES}) GROUP BY 1), covered AS (SELECT table_name, count(*) AS rule_count, "
    "count(DISTINCT upper(column_name)) AS covered_cols FROM given WHERE is_active GROUP BY 1), coverage AS ("
    f"SELECT '{DATABASE}.{SCHEMA}.' || table_name AS table_fqn, table_name, coalesce(rule_count, 0) AS rule_count, n_cols, coalesce(covered_cols, 0) AS covered_cols, "
    "round(100 * coalesce(covered_cols, 0)::DOUBLE / nullif(n_cols, 0), 0) AS coverage_pct "
    "FROM widths LEFT JOIN covered USING (table_name))")
_register("rule_coverage", lambda s, d: reports.rule_coverage(_given_rules(s, d), registry(s, d).columns()), None)
ORACLE["rule_coverage"] = with_inputs("", "rules").rstrip() + _COVERAGE + " SELECT * FROM coverage"


def _overview(spark, sf_dir):
    known = registry(spark, sf_dir)
    return reports.schema_overview(known.tables(), known.columns(), known.row_counts(), _given_rules(spark, sf_dir),
                                   _given_health(spark, sf_dir), DATABASE, SCHEMA)


def _two_schemas(spark, sf_dir):
    """Two schemas that hold a table of the same name: only the one asked for may count."""
    known = Registry(spark)
    for schema, table in (("A", "orders"), ("B", "nation"), ("A", "region")):
        known.register(f"LAKE.{schema}.{'T' if table != 'region' else 'R'}", read(spark, sf_dir, table))
    rules = catalog(spark, sf_dir).withColumns({
        "schema_name": F.when(F.col("rule_id") % 3 == 0, "b").otherwise("A"), "database_name": F.lit("Lake"),
        "table_name": F.when(F.col("rule_id") % 5 == 0, "R").otherwise("t"),
        "column_name": F.when(F.col("rule_id") % 2 == 0, "O_ORDERKEY").otherwise("n_name")})
    named = rules.select("rule_id", F.concat_ws(".", "database_name", "schema_name", "table_name").alias("table_fqn"))
    health = scoring.table_health(_latest(spark, sf_dir).drop("table_fqn").join(named, "rule_id"))
    return reports.schema_overview(known.tables(), known.columns(), known.row_counts(), rules, health, "lake", "A")


_register("schema_overview_two_schemas", _two_schemas,
          f"SELECT table_name, 'BASE TABLE' AS table_type, row_count, rule_count, n_cols, "
          f"round(100 * covered::DOUBLE / n_cols, 0) AS coverage_pct, dq_score FROM ("
          "SELECT 'T' AS table_name, (SELECT count(*) FROM orders) AS row_count, 6::BIGINT AS n_cols UNION ALL "
          "SELECT 'R', (SELECT count(*) FROM region), 2) LEFT JOIN (SELECT CASE WHEN rule_id % 5 = 0 THEN 'R' ELSE 'T' END AS table_name, "
          "count(*) AS rule_count, count(DISTINCT rule_id % 2) AS covered FROM rules WHERE is_active AND rule_id % 3 <> 0 GROUP BY 1) "
          f"USING (table_name) LEFT JOIN (SELECT CASE WHEN rule_id % 5 = 0 THEN 'R' ELSE 'T' END AS table_name, {SCORE_SQL} AS dq_score "
          "FROM latest WHERE rule_id % 3 <> 0 GROUP BY 1) USING (table_name)", "latest", "rules")
_register("result_tables", _of(history, reports.result_tables), "SELECT DISTINCT table_fqn FROM results", "results")
_register("schema_choices", _of(catalog, reports.schema_choices), "SELECT DISTINCT database_name, schema_name FROM rules", "rules")
_ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
_register("schema_overview", _overview, None)
ORACLE["schema_overview"] = with_inputs("", "latest").rstrip() + _COVERAGE + (
    f", counted AS ({_ROW_COUNTS}), scores AS (SELECT g.table_name, {SCORE_SQL} AS dq_score FROM latest l JOIN given g "
    "USING (rule_id) GROUP BY 1) SELECT table_name, 'BASE TABLE' AS table_type, row_count, rule_count, n_cols, "
    "coverage_pct, dq_score FROM counted LEFT JOIN coverage USING (table_name) LEFT JOIN scores USING (table_name)")
_register("row_counts", lambda s, d: registry(s, d).row_counts().select("table_name", "row_count"), _ROW_COUNTS)
_register("table_sizes", lambda s, d: registry(s, d).sizes(), None)
_register("table_statistics", lambda s, d: registry(s, d).statistics().drop("table_fqn"), " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, {nulls} AS null_count, "
    f"{low} AS min_value, {high} AS max_value FROM {table}"
    for table, kinds in TABLE_COLUMNS.items() for kind, names in zip("iox", kinds) for c in names.split()
    for nulls in (["NULL::BIGINT"] if kind == "x" else [f"count(*) FILTER ({c} IS NULL)"])
    for low, high in ([(f"min({c})::VARCHAR", f"max({c})::VARCHAR")] if kind == "i" else [("NULL::VARCHAR", "NULL::VARCHAR")])))
_register("column_discovery",
          lambda s, d: registry(s, d).columns().join(registry(s, d).row_counts().select("table_fqn", "row_count"), "table_fqn")
          .select("table_name", "column_name", "ordinal_position", "row_count"),
          f"SELECT table_name, column_name, ordinal_position, row_count FROM information_schema.columns "
          f"JOIN ({_ROW_COUNTS}) USING (table_name)")

# -- keyed table maintenance --------------------------------------------------------------------------


def _edits(spark, sf_dir, columns):
    """Edited rules from the orders: one per customer who ordered, some equal to the catalog."""
    orders = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))
    return orders.select("rule_id", (F.col("n") % 3).cast("double").alias("threshold_pct"),
                         F.when(F.col("s") == "P", "HIGH").otherwise("LOW").alias("severity")).select("rule_id", *columns)


_EDITS = ("(SELECT o_custkey * 2 AS rule_id, (count(*) % 3)::DOUBLE AS threshold_pct, "
          "CASE WHEN max(o_orderstatus) = 'P' THEN 'HIGH' ELSE 'LOW' END AS severity FROM orders GROUP BY 1)")
_KEPT = ("rule_id", "rule_name", "threshold_pct", "severity")


def _merge(spark, sf_dir, insert_only=False):
    target = catalog(spark, sf_dir).select(*_KEPT)
    return merge_rows(target, _edits(spark, sf_dir, ("threshold_pct", "severity")), ["rule_id"], insert_only)


_register("upsert_rows", _merge,
          f"SELECT rule_id, r.rule_name, CASE WHEN e.rule_id IS NULL THEN r.threshold_pct ELSE e.threshold_pct END AS "
          f"threshold_pct, CASE WHEN e.rule_id IS NULL THEN r.severity ELSE e.severity END AS severity "
          f"FROM rules r FULL JOIN {_EDITS} e USING (rule_id)", "rules")
_register("insert_missing_rows", partial(_merge, insert_only=True),
          f"SELECT rule_id, r.rule_name, CASE WHEN r.rule_id IS NULL THEN e.threshold_pct ELSE r.threshold_pct END AS "
          f"threshold_pct, CASE WHEN r.rule_id IS NULL THEN e.severity ELSE r.severity END AS severity "
          f"FROM rules r FULL JOIN {_EDITS} e USING (rule_id)", "rules")
_register("delete_rows", lambda s, d: delete_rows(catalog(s, d), _edits(s, d, ()), ["rule_id"]).select(*_KEPT),
          f"SELECT rule_id, rule_name, threshold_pct, severity FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM {_EDITS})",
          "rules")
_register("changed_rows",
          lambda s, d: changed_rows(catalog(s, d), _edits(s, d, ("threshold_pct", "severity")), "rule_id",
                                    ("threshold_pct", "severity")),
          f"SELECT e.rule_id, e.threshold_pct, e.severity FROM {_EDITS} e JOIN rules r USING (rule_id) "
          "WHERE e.threshold_pct IS DISTINCT FROM r.threshold_pct OR e.severity IS DISTINCT FROM r.severity", "rules")


def _rules_csv(spark, sf_dir):
    path = work_folder(spark, "rules-csv")
    export_rules(catalog(spark, sf_dir), path)
    return import_rules(spark, path)


_IMPORTED = ("SELECT rule_name, description, database_name, schema_name, table_name, column_name, rule_type, "
             "coalesce(rule_params, '{}') AS rule_params, row_filter, coalesce(threshold_pct, 0) AS threshold_pct, "
             "upper(coalesce(severity, 'MEDIUM')) AS severity, coalesce(dimension, 'Validity') AS dimension, owner FROM ")
_register("rules_csv_roundtrip", _rules_csv, _IMPORTED + "rules", "rules")
_register("rule_import_defaults",
          lambda s, d: normalise_rules(catalog(s, d).withColumn("severity", F.lower(F.nullif("severity", F.lit("LOW"))))
                                       .withColumn("rule_params", F.lit(None).cast("string"))
                                       .withColumn("threshold_pct", F.nullif("threshold_pct", F.lit(1.0)))),
          _IMPORTED + "(SELECT * REPLACE (lower(nullif(severity, 'LOW')) AS severity, NULL::VARCHAR AS rule_params, "
          "nullif(threshold_pct, 1) AS threshold_pct) FROM rules)", "rules")


# -- the catalog in a store ------------------------------------------------------------------------------

_STAMP = AS_OF.replace(hour=9)


def _inserted(spark, sf_dir):
    """The rules of all customers, inserted in key order: they get the ids 1, 2, 3, ..."""
    store = Store(spark, work_folder(spark, "catalog"))
    store.insert(RULES, catalog(spark, sf_dir).orderBy("rule_id").drop("is_active"), as_of=AS_OF)
    return store


def _edited_store(spark, sf_dir):
    store = _inserted(spark, sf_dir)
    before = store.rows(RULES)
    store.update(RULES, before.where("rule_id % 3 = 0").withColumn("threshold_pct", F.lit(2.0)), as_of=_STAMP, columns=("threshold_pct",))
    store.update(RULES, store.rows(RULES).where("rule_id % 4 = 0").withColumn("is_active", F.lit(False)), as_of=_STAMP, columns=("is_active",))
    store.delete(RULES, store.rows(RULES).where("rule_id % 5 = 0"))
    store.compact(RULES)
    return store.rows(RULES).select("rule_id", "rule_name", "threshold_pct", "is_active", (F.col("updated_at") > F.lit(AS_OF)).alias("edited"))


_NUMBERED = ("(SELECT row_number() OVER (ORDER BY c_custkey) AS rule_id, 'rule ' || c_custkey AS rule_name, "
             "(c_custkey % 3)::DOUBLE AS threshold_pct FROM customer)")
_register("rule_store_edits", _edited_store,
          "SELECT rule_id, rule_name, CASE WHEN rule_id % 3 = 0 THEN 2.0::DOUBLE ELSE threshold_pct END AS threshold_pct, "
          "rule_id % 4 <> 0 AS is_active, (rule_id % 3 = 0 AND threshold_pct <> 2) OR rule_id % 4 = 0 AS edited "
          f"FROM {_NUMBERED} WHERE rule_id % 5 <> 0")


def _policy_store(spark, sf_dir):
    """One policy per supplier: inserted, some toggled off, edited and deleted."""
    store = Store(spark, work_folder(spark, "policies"))
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select(
        F.col("s_name").alias("alert_name"), F.lit("EMAIL").alias("channel_type"), F.lit("team@example.com").alias("recipients"),
        F.col("s_acctbal").alias("min_score"))
    store.insert(POLICIES, rows, as_of=AS_OF)
    store.update(POLICIES, store.rows(POLICIES).where("min_score < 0").withColumn("is_enabled", F.lit(False)), as_of=_STAMP, columns=("is_enabled",))
    store.update(POLICIES, store.rows(POLICIES).where("min_score > 100").withColumn("min_score", F.lit(100.0)), as_of=_STAMP, columns=("min_score",))
    store.delete(POLICIES, store.rows(POLICIES).where("alert_id % 4 = 0"))
    return store.rows(POLICIES).select("alert_id", "alert_name", "is_enabled", F.col("min_score").cast("double").alias("min_score"))


_register("policy_store_edits", _policy_store,
          "SELECT alert_id, s_name AS alert_name, s_acctbal >= 0 AS is_enabled, least(s_acctbal, 100.0::DOUBLE) AS min_score FROM ("
          "SELECT row_number() OVER (ORDER BY s_suppkey) AS alert_id, * FROM supplier) WHERE alert_id % 4 <> 0")


def _imported_catalog(spark, sf_dir):
    path = work_folder(spark, "rules-in")
    export_rules(_inserted(spark, sf_dir).rows(RULES), path)
    store = Store(spark, work_folder(spark, "catalog"))
    import_into_catalog(store, path, as_of=AS_OF)
    return store.rows(RULES).select("rule_name", "rule_type", "threshold_pct", "is_active")


_register("rules_csv_import", _imported_catalog, "SELECT rule_name, rule_type, threshold_pct, true AS is_active FROM rules", "rules")


def _two_writers(spark, sf_dir):
    """Two sessions insert halves of the customers' rules and edit the same rows, each from what it read
    before the other wrote."""
    first, second = Store(spark, work_folder(spark, "catalog")), None
    second = Store(spark, first.root)
    rules = catalog(spark, sf_dir).orderBy("rule_id").drop("is_active")
    first.insert(RULES, rules.where("rule_id % 2 = 0"), as_of=AS_OF)
    seen = second.rows(RULES)
    first.insert(RULES, rules.where("rule_id % 2 = 1"), as_of=AS_OF)
    first.update(RULES, seen.withColumn("severity", F.lit("LOW")), as_of=_STAMP, columns=("severity",))
    second.update(RULES, seen.withColumn("threshold_pct", F.lit(7.0)), as_of=_STAMP, columns=("threshold_pct",))
    second.delete(RULES, first.rows(RULES).where("rule_id % 10 = 0"))
    return second.rows(RULES).select("rule_id", "rule_name", "severity", "threshold_pct")


_register("two_writers", _two_writers,
          "SELECT rule_id, rule_name, CASE WHEN half = 0 THEN 'LOW' ELSE severity END AS severity, "
          "CASE WHEN half = 0 THEN 7.0::DOUBLE ELSE threshold_pct END AS threshold_pct FROM ("
          "SELECT row_number() OVER (ORDER BY rule_id % 2, rule_id) AS rule_id, rule_name, upper(severity) AS severity, threshold_pct, "
          "rule_id % 2 AS half FROM rules) WHERE rule_id % 10 <> 0", "rules")

# -- the two newest results of every rule, kept up to date by appends -----------------------------------


def results_in_batches(spark, sf_dir) -> Store:
    """The history in four appends: newest days before oldest, and a last one of rows from all days."""
    store = Store(spark, work_folder(spark, "newest"))
    late = F.col("result_id").cast("long") % 11 == 0
    results = history(spark, sf_dir)
    for batch in (results.where(~late & (F.dayofmonth("run_ts") > 20)), results.where(~late & (F.dayofmonth("run_ts") <= 10)),
                  results.where(~late & F.dayofmonth("run_ts").between(11, 20)), results.where(late)):
        store.append(RESULTS, batch)
    return store


_NEWEST_TWO = ("(SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY run_ts DESC, result_id DESC) <= 2)")
_register("newest_results_store", lambda s, d: results_in_batches(s, d).newest_results().select(*RESULT_COLUMNS),
          f"SELECT {_RC} FROM {_NEWEST_TWO}", "results")


def _rebuilt(spark, sf_dir):
    """Computed anew after retention has dropped the first three weeks."""
    store = results_in_batches(spark, sf_dir)
    store.prune(RESULTS, AS_OF.replace(hour=7), 4)
    store.rebuild_newest_results()
    return store.newest_results().select(*RESULT_COLUMNS)


_register("newest_results_rebuilt", _rebuilt,
          f"SELECT {_RC} FROM {_NEWEST_TWO} WHERE run_ts >= TIMESTAMP '2024-01-27 07:00:00'", "results")


def _pruned_newest(spark, sf_dir):
    store = results_in_batches(spark, sf_dir)
    store.prune(RESULTS, AS_OF.replace(hour=7), 4)
    return scoring.latest_results(store.newest_results(), catalog(spark, sf_dir)).select(*RESULT_COLUMNS, "owner")


_register("latest_results_store", _pruned_newest,
          f"SELECT {_RC}, owner FROM latest WHERE run_ts >= TIMESTAMP '2024-01-27 07:00:00'", "latest")


# -- counts per day, kept up to date by refreshes ---------------------------------------------------------


def _rolled(spark, sf_dir) -> Store:
    """Refreshed before late results of all days are appended and the first week is dropped, and once after."""
    store = Store(spark, work_folder(spark, "rollup"))
    late = F.col("result_id").cast("long") % 50 == 0
    store.append(RESULTS, history(spark, sf_dir).where(~late))
    store.refresh_rollup()
    store.append(RESULTS, history(spark, sf_dir).where(late & (F.dayofmonth("run_ts") > 20)))
    store.refresh_rollup()
    store.append(RESULTS, history(spark, sf_dir).where(late & (F.dayofmonth("run_ts") <= 20)))
    store.prune(RESULTS, AS_OF.replace(hour=7), 23)
    return store


_KEPT_DAILY = ("kept AS (SELECT *, run_ts::DATE AS run_date, CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 "
               "WHEN 'LOW' THEN 1 END AS weight FROM results WHERE run_ts >= TIMESTAMP '2024-01-08 07:00:00' "
               "QUALIFY row_number() OVER (PARTITION BY rule_id, run_ts::DATE ORDER BY run_ts DESC, result_id DESC) = 1)")
_register("rollup_table_score", lambda s, d: scoring.rolled_table_score(_rolled(s, d).rollup()), None)
ORACLE["rollup_table_score"] = with_inputs("", "results").rstrip() + ", " + _KEPT_DAILY + (
    " SELECT run_date, table_fqn, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, "
    f"count(*) FILTER (status = 'ERROR') AS errors, {SCORE_SQL} AS dq_score FROM kept GROUP BY 1, 2")


def _refreshed_trend(spark, sf_dir):
    store = _rolled(spark, sf_dir)
    store.refresh_rollup()
    return scoring.rolled_score_trend(store.rollup(), AS_OF, 30)


_register("rollup_trend", _refreshed_trend, None)
ORACLE["rollup_trend"] = with_inputs("", "results").rstrip() + ", " + _KEPT_DAILY + (
    f" SELECT run_date, {SCORE_SQL} AS dq_score, count(*) AS checks, count(*) FILTER (status <> 'PASS') AS issues FROM kept GROUP BY 1")
_register("rollup_heat_map", lambda s, d: scoring.rolled_heat_map(_rolled(s, d).rollup()), None)
ORACLE["rollup_heat_map"] = with_inputs("", "results").rstrip() + ", " + _KEPT_DAILY + (
    " SELECT run_date, dimension, status, count(*) AS n FROM kept GROUP BY 1, 2, 3")
_register("newest_failures_store",
          lambda s, d: _stored(s, d).newest(RESULTS, 200, F.col("status") == "FAIL").select("result_id", "run_ts", "rule_id", "status"),
          "SELECT result_id, run_ts, rule_id, status FROM results WHERE status = 'FAIL' ORDER BY run_ts DESC, result_id DESC LIMIT 200", "results")
