"""Inputs shared by the registered queries, on the Spark side and as SQL for the comparison.

The history and the catalog are projections of the given tables: every event is one recorded
result (its user is the rule) and every customer is one rule.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.model import DIMENSIONS, RULE_DIMENSIONS, SEVERITIES
from plumbline.sources.registry import Registry

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
DATABASE, SCHEMA = "LAKE", "RETAIL"
# Columns of the given tables: integers, other values, complex ones.
TABLE_COLUMNS = {
    "region": ("r_regionkey", "r_name", ""),
    "nation": ("n_nationkey n_regionkey", "n_name", ""),
    "customer": ("c_custkey c_nationkey", "c_name c_acctbal c_mktsegment", ""),
    "supplier": ("s_suppkey s_nationkey", "s_name s_acctbal", ""),
    "part": ("p_partkey p_size", "p_name p_brand p_type p_retailprice", ""),
    "orders": ("o_orderkey o_custkey", "o_orderstatus o_totalprice o_orderdate o_orderpriority", ""),
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber",
                 "l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", ""),
    "events": ("event_id user_id", "ts event_type value props", ""),
    "documents": ("doc_id n_chars", "text lang source", ""),
    "embeddings": ("vec_id label", "", "embedding"),
    "pages": ("page_id", "url html", ""),
    "benchmark": ("item_id", "text", ""),
    "labels": ("doc_id quality toxic", "", ""),
    "conversations": ("conv_id turn", "role text", ""),
}
MONITORED = ("ORDERS", "CUSTOMERS", "PRODUCTS", "INVENTORY", "PAYMENTS", "SHIPMENTS", "RETURNS", "STORES")
TYPES = tuple(RULE_DIMENSIONS)
TRIGGERS = ("SCHEDULE", "MANUAL", "BACKFILL")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str, *names: str) -> Registry:
    known = Registry(spark)
    for name in names or TABLES:
        known.register(f"{DATABASE}.{SCHEMA}.{name}", partial(read, spark, sf_dir, name), path=f"{sf_dir}/{name}.parquet")
    return known


def _pick(words: tuple, index: str) -> F.Column:
    listed = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
    return F.expr(f"get(array({listed}), CAST({index} AS INT))")


def _pick_sql(words: tuple, index: str) -> str:
    listed = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
    return f"([{listed}])[({index}) + 1]"


_SEVERITY = (*SEVERITIES, "INFO")
_DIMENSION = (*DIMENSIONS, None)
_COLUMN = (None, "AMOUNT", "STATUS", "CREATED", "EMAIL")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    ran = F.col("event_type") != "error"
    return events.select(
        F.col("event_id").cast("string").alias("result_id"),
        F.date_format("ts", "yyyyMMdd").alias("run_id"),
        F.col("ts").alias("run_ts"),
        F.col("user_id").alias("rule_id"),
        F.concat(F.lit("rule "), F.col("user_id").cast("string")).alias("rule_name"),
        F.concat(F.lit(f"{DATABASE}.{SCHEMA}."), _pick(MONITORED, "user_id % 8")).alias("table_fqn"),
        _pick(_COLUMN, "user_id % 5").alias("column_name"),
        _pick(TYPES, "user_id % 9").alias("rule_type"),
        _pick(_DIMENSION, "user_id % 7").alias("dimension"),
        _pick(_SEVERITY, "user_id % 5").alias("severity"),
        F.when(ran, 1000 + F.col("event_id") % 500).alias("total_rows"),
        F.when(ran, F.col("event_id") % 97).alias("failed_rows"),
        F.when(ran, F.col("value") / 5).alias("failed_pct"),
        (F.col("user_id") % 3).cast("double").alias("threshold_pct"),
        F.when(~ran, "ERROR").when(F.col("event_type") == "view", "FAIL").otherwise("PASS").alias("status"),
        F.when(~ran, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error_message"),
        (F.col("event_id") % 1000).alias("duration_ms"),
        F.lit("SELECT 1").alias("check_sql"),
        F.lit("SELECT 2").alias("sample_sql"),
        _pick(TRIGGERS, "event_id % 3").alias("triggered_by"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("rule_id"),
        F.concat(F.lit("rule "), key.cast("string")).alias("rule_name"),
        F.concat(F.lit("Checks "), "c_mktsegment").alias("description"),
        F.lit(DATABASE).alias("database_name"),
        F.lit(SCHEMA).alias("schema_name"),
        _pick(MONITORED, "c_custkey % 8").alias("table_name"),
        _pick(_COLUMN, "c_custkey % 5").alias("column_name"),
        _pick(TYPES, "c_custkey % 9").alias("rule_type"),
        F.lit("{}").alias("rule_params"),
        F.lit(None).cast("string").alias("row_filter"),
        (key % 3).cast("double").alias("threshold_pct"),
        _pick(_SEVERITY, "c_custkey % 5").alias("severity"),
        _pick(_DIMENSION, "c_custkey % 7").alias("dimension"),
        F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")).alias("owner"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


# -- the same inputs as SQL -----------------------------------------------------------------------

_RESULTS = f"""results AS (
  SELECT event_id::VARCHAR AS result_id, strftime(ts, '%Y%m%d') AS run_id, ts AS run_ts, user_id AS rule_id,
         'rule ' || user_id AS rule_name,
         '{DATABASE}.{SCHEMA}.' || {_pick_sql(MONITORED, 'user_id % 8')} AS table_fqn,
         {_pick_sql(_COLUMN, 'user_id % 5')} AS column_name, {_pick_sql(TYPES, 'user_id % 9')} AS rule_type,
         {_pick_sql(_DIMENSION, 'user_id % 7')} AS dimension, {_pick_sql(_SEVERITY, 'user_id % 5')} AS severity,
         CASE WHEN event_type <> 'error' THEN 1000 + event_id % 500 END AS total_rows,
         CASE WHEN event_type <> 'error' THEN event_id % 97 END AS failed_rows,
         CASE WHEN event_type <> 'error' THEN value / 5 END AS failed_pct,
         (user_id % 3)::DOUBLE AS threshold_pct,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'FAIL' ELSE 'PASS' END AS status,
         CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error_message,
         event_id % 1000 AS duration_ms, 'SELECT 1' AS check_sql, 'SELECT 2' AS sample_sql,
         {_pick_sql(TRIGGERS, 'event_id % 3')} AS triggered_by
  FROM events)"""
_RULES = f"""rules AS (
  SELECT c_custkey AS rule_id, 'rule ' || c_custkey AS rule_name, 'Checks ' || c_mktsegment AS description,
         '{DATABASE}' AS database_name, '{SCHEMA}' AS schema_name,
         {_pick_sql(MONITORED, 'c_custkey % 8')} AS table_name, {_pick_sql(_COLUMN, 'c_custkey % 5')} AS column_name,
         {_pick_sql(TYPES, 'c_custkey % 9')} AS rule_type, '{{}}' AS rule_params, NULL::VARCHAR AS row_filter,
         (c_custkey % 3)::DOUBLE AS threshold_pct, {_pick_sql(_SEVERITY, 'c_custkey % 5')} AS severity,
         {_pick_sql(_DIMENSION, 'c_custkey % 7')} AS dimension,
         CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END AS owner, c_acctbal >= 0 AS is_active
  FROM customer)"""
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"
SCORE_SQL = ("round(100 * sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END)::DOUBLE / nullif(sum(weight), 0)::DOUBLE, 1)")
COUNTS_SQL = ("count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed, "
              "count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errors")
_LATEST = f"""latest AS (
  SELECT r.*, {_WEIGHT.replace('severity', 'r.severity')} AS weight, ru.owner, ru.description
  FROM results r JOIN rules ru ON ru.rule_id = r.rule_id AND ru.is_active
  QUALIFY row_number() OVER (PARTITION BY r.rule_id ORDER BY r.run_ts DESC, r.result_id DESC) = 1)"""
_PREVIOUS = """previous AS (
  SELECT * FROM results
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY run_ts DESC, result_id DESC) = 2)"""
_DAILY = f"""daily AS (
  SELECT *, run_ts::DATE AS run_date, {_WEIGHT} AS weight FROM results
  QUALIFY row_number() OVER (PARTITION BY rule_id, run_ts::DATE ORDER BY run_ts DESC, result_id DESC) = 1)"""
_HEALTH = f"""health AS (
  SELECT table_fqn, {COUNTS_SQL}, count(*) FILTER (status <> 'PASS' AND severity = 'CRITICAL') AS critical_issues,
         {SCORE_SQL} AS dq_score, max(run_ts) AS last_run_ts
  FROM latest GROUP BY table_fqn)"""
_TABLE_SCORE = f"""table_score AS (
  SELECT run_date, table_fqn, {COUNTS_SQL}, {SCORE_SQL} AS dq_score FROM daily GROUP BY run_date, table_fqn)"""
_TREND = f"""trend AS (
  SELECT run_date, {SCORE_SQL} AS dq_score, count(*) AS checks, count(*) FILTER (status <> 'PASS') AS issues
  FROM daily WHERE run_date >= DATE '2024-01-01' GROUP BY run_date)"""

_CTES = {
    "results": (_RESULTS, ()),
    "rules": (_RULES, ()),
    "latest": (_LATEST, ("results", "rules")),
    "previous": (_PREVIOUS, ("results",)),
    "daily": (_DAILY, ("results",)),
    "health": (_HEALTH, ("latest",)),
    "table_score": (_TABLE_SCORE, ("daily",)),
    "trend": (_TREND, ("daily",)),
}
BAND_SQL = "CASE WHEN {0} IS NULL THEN 'muted' WHEN {0} >= 95 THEN 'good' WHEN {0} >= 80 THEN 'warn' ELSE 'bad' END"


def with_inputs(query: str, *names: str) -> str:
    """Prefix a query with the named inputs and whatever they build on."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][1]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(_CTES[n][0] for n in needed) + "\n" + query
