"""Rule checks, samples and runs over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.model import Rule
from plumbline.operators.checks import compile_rule, failing_rows
from plumbline.plans.engine import active_rules, preview_rules, preview_totals, run_checks, stored_sample, summarize
from plumbline.sources.registry import Registry
from workload.base import AS_OF, AS_OF_SQL, DATABASE, SCHEMA, TABLES, catalog, read, registry, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHOWN = ("rule_id", "rule_type", "total_rows", "failed_rows", "failed_pct", "status")


def rule(number: int, table: str, kind: str, column: str | None = None, params: dict | None = None,
         row_filter: str | None = None, threshold: float = 0.0) -> Rule:
    return Rule(number, f"{table} {kind} {number}", DATABASE, SCHEMA, table, kind, column, params or {}, row_filter,
                threshold, "HIGH", "Validity")


def inputs(spark: SparkSession, sf_dir: str) -> Registry:
    """The given tables and views that inject defects into them (the tables hold no NULLs and no
    orphans)."""
    known = registry(spark, sf_dir)
    known.register(f"{DATABASE}.{SCHEMA}.orders_open", lambda: read(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))).withColumn(
        "o_custkey", F.when(F.col("o_orderpriority").isNotNull(), F.col("o_custkey"))))
    known.register(f"{DATABASE}.{SCHEMA}.builders", lambda: read(spark, sf_dir, "customer").where(
        "c_mktsegment = 'BUILDING'"))
    return known


# Views as SQL. In orders_open the customer key is missing where the priority is.
VIEWS = {
    "orders_open": "(SELECT * REPLACE (nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, "
                   "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey END AS o_custkey) FROM orders)",
    "builders": "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')",
}


def verdict(number: int, kind: str, total: str, failed: str, source: str, threshold: float = 0.0) -> str:
    pct = "CASE WHEN total_rows = 0 THEN 0.0 ELSE round(100.0::DOUBLE * failed_rows / total_rows, 4) END"
    return (f"SELECT {number}::BIGINT AS rule_id, '{kind}' AS rule_type, total_rows, failed_rows, {pct} AS failed_pct, "
            f"CASE WHEN {pct} > {threshold} THEN 'FAIL' ELSE 'PASS' END AS status "
            f"FROM (SELECT ({total})::BIGINT AS total_rows, ({failed})::BIGINT AS failed_rows FROM {source})")


def rows_where(number: int, kind: str, predicate: str, source: str, threshold: float = 0.0) -> str:
    return verdict(number, kind, "count(*)", f"count(*) FILTER ({predicate})", source, threshold)


def repeated(number: int, keys: str, source: str) -> str:
    return verdict(number, "UNIQUE", "coalesce(sum(n), 0)", "coalesce(sum(n) FILTER (n > 1), 0)",
                   f"(SELECT count(*) AS n FROM {source} GROUP BY {keys})")


def orphaned(number: int, fk: str, source: str, parent: str, key: str, threshold: float = 0.0) -> str:
    return rows_where(number, "REFERENTIAL", f"{fk} IS NOT NULL AND ref IS NULL",
                      f"(SELECT * FROM {source} LEFT JOIN (SELECT DISTINCT {key} AS ref FROM {parent}) ON {fk} = ref)",
                      threshold)


def _check(*rules: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_checks(spark, rules, inputs(spark, sf_dir), as_of=AS_OF).select(*SHOWN)
    return query


def _register(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


O_OPEN, BUILDERS = VIEWS["orders_open"], VIEWS["builders"]
FRESH_SQL = ("date_diff('minute', max(ts), " + AS_OF_SQL + ")")

_register("check_not_null", _check(rule(1, "orders_open", "NOT_NULL", "o_orderpriority")),
          rows_where(1, "NOT_NULL", "o_orderpriority IS NULL", O_OPEN))
_register("check_unique", _check(rule(2, "part", "UNIQUE", "p_name")), repeated(2, "p_name", "part"))
_register("check_unique_composite", _check(rule(3, "lineitem", "UNIQUE", "l_orderkey, l_linenumber")),
          repeated(3, "l_orderkey, l_linenumber", "lineitem"))
_register("check_unique_null_keys", _check(rule(4, "orders_open", "UNIQUE", "o_custkey,o_orderpriority")),
          repeated(4, "o_custkey, o_orderpriority", O_OPEN))
_register("check_unique_text", _check(rule(5, "documents", "UNIQUE", "text")), repeated(5, "text", "documents"))
_register("check_accepted_values",
          _check(rule(6, "orders", "ACCEPTED_VALUES", "o_orderstatus", {"values": ["O", "F"]})),
          rows_where(6, "ACCEPTED_VALUES", "o_orderstatus NOT IN ('O', 'F')", "orders"))
_register("check_range", _check(rule(7, "customer", "RANGE", "c_acctbal", {"min": 0}),
                                rule(8, "lineitem", "RANGE", "l_quantity", {"min": 2, "max": 49}),
                                rule(9, "orders", "RANGE", "o_orderdate", {"min": "1996-01-01"})),
          " UNION ALL ".join([rows_where(7, "RANGE", "c_acctbal < 0", "customer"),
                              rows_where(8, "RANGE", "l_quantity < 2 OR l_quantity > 49", "lineitem"),
                              rows_where(9, "RANGE", "o_orderdate < DATE '1996-01-01'", "orders")]))
_register("check_regex", _check(rule(10, "pages", "REGEX", "url", {"pattern": "https://.*"}),
                                rule(11, "part", "REGEX", "p_brand", {"pattern": r"Brand#[0-9]"}, None, 90.0)),
          " UNION ALL ".join([
              rows_where(10, "REGEX", "NOT regexp_full_match(url, 'https://.*')", "pages"),
              rows_where(11, "REGEX", "NOT regexp_full_match(p_brand, 'Brand#[0-9]')", "part", 90.0)]))
_register("check_freshness", _check(rule(12, "events", "FRESHNESS", "ts", {"max_age_hours": 24}),
                                    rule(13, "events", "FRESHNESS", "ts", {"max_age_hours": 0.04}),
                                    rule(14, "orders", "FRESHNESS", "o_orderdate")),
          " UNION ALL ".join([
              verdict(12, "FRESHNESS", "1", f"CASE WHEN {FRESH_SQL} > 1440 THEN 1 ELSE 0 END", "events"),
              verdict(13, "FRESHNESS", "1", f"CASE WHEN {FRESH_SQL} > 2 THEN 1 ELSE 0 END", "events"),
              verdict(14, "FRESHNESS", "1",
                      f"CASE WHEN {FRESH_SQL.replace('ts', 'o_orderdate')} > 1440 THEN 1 ELSE 0 END", "orders")]))
_register("check_row_count",
          _check(*[rule(20 + i, t, "ROW_COUNT", None, {"min": 100, "max": 50_000}) for i, t in enumerate(TABLES)]),
          " UNION ALL ".join(verdict(20 + i, "ROW_COUNT", "1",
                                     "CASE WHEN count(*) < 100 OR count(*) > 50000 THEN 1 ELSE 0 END", t)
                             for i, t in enumerate(TABLES)))
_REF = {"ref_table": f"{DATABASE}.{SCHEMA}.builders", "ref_column": "c_custkey"}
_register("check_referential", _check(rule(40, "orders", "REFERENTIAL", "o_custkey", _REF)),
          orphaned(40, "o_custkey", "orders", BUILDERS, "c_custkey"))
_register("check_referential_null_keys", _check(rule(41, "orders_open", "REFERENTIAL", "o_custkey", _REF, None, 70.0)),
          orphaned(41, "o_custkey", O_OPEN, BUILDERS, "c_custkey", 70.0))
_register("check_custom_sql",
          _check(rule(42, "lineitem", "CUSTOM_SQL", "l_discount", {"failure_condition": "l_discount > l_tax"}),
                 rule(43, "lineitem", "CUSTOM_SQL", "l_discount", {"failure_condition": "l_discount > l_tax"},
                      "l_returnflag = 'R' AND l_quantity >= 10")),
          " UNION ALL ".join([rows_where(42, "CUSTOM_SQL", "l_discount > l_tax", "lineitem"),
                              rows_where(43, "CUSTOM_SQL", "l_discount > l_tax",
                                         "(SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10)")]))

# -- whole runs -------------------------------------------------------------------------------------

RUN_RULES = (
    rule(1, "orders_open", "NOT_NULL", "o_orderpriority"),
    rule(2, "orders_open", "NOT_NULL", "o_custkey", None, "o_orderstatus = 'O'", 25.0),
    rule(3, "orders", "UNIQUE", "o_orderkey"),
    rule(4, "lineitem", "UNIQUE", "l_orderkey,l_linenumber", threshold=50.0),
    rule(5, "orders", "ACCEPTED_VALUES", "o_orderstatus", {"values": ["O", "F"]}),
    rule(6, "customer", "RANGE", "c_acctbal", {"min": 0}, threshold=10.0),
    rule(7, "pages", "REGEX", "url", {"pattern": "https://.*"}),
    rule(8, "events", "FRESHNESS", "ts", {"max_age_hours": 24}),
    rule(9, "lineitem", "ROW_COUNT", None, {"min": 1}),
    rule(10, "lineitem", "REFERENTIAL", "l_orderkey", {"ref_table": f"{DATABASE}.{SCHEMA}.orders", "ref_column": "o_orderkey"}),
    rule(11, "orders", "REFERENTIAL", "o_custkey", _REF),
    rule(12, "lineitem", "CUSTOM_SQL", "l_discount", {"failure_condition": "l_discount > l_tax"}, None, 60.0),
)
_RUN_SQL = " UNION ALL ".join([
    rows_where(1, "NOT_NULL", "o_orderpriority IS NULL", O_OPEN),
    rows_where(2, "NOT_NULL", "o_custkey IS NULL", f"(SELECT * FROM {O_OPEN} WHERE o_orderstatus = 'O')", 25.0),
    repeated(3, "o_orderkey", "orders"),
    repeated(4, "l_orderkey, l_linenumber", "lineitem").replace("> 0.0 THEN", "> 50.0 THEN"),
    rows_where(5, "ACCEPTED_VALUES", "o_orderstatus NOT IN ('O', 'F')", "orders"),
    rows_where(6, "RANGE", "c_acctbal < 0", "customer", 10.0),
    rows_where(7, "REGEX", "NOT regexp_full_match(url, 'https://.*')", "pages"),
    verdict(8, "FRESHNESS", "1", f"CASE WHEN {FRESH_SQL} > 1440 THEN 1 ELSE 0 END", "events"),
    verdict(9, "ROW_COUNT", "1", "CASE WHEN count(*) < 1 THEN 1 ELSE 0 END", "lineitem"),
    orphaned(10, "l_orderkey", "lineitem", "orders", "o_orderkey"),
    orphaned(11, "o_custkey", "orders", BUILDERS, "c_custkey"),
    rows_where(12, "CUSTOM_SQL", "l_discount > l_tax", "lineitem", 60.0),
])
_register("run_all_rules", _check(*RUN_RULES), _RUN_SQL)
_register("run_summary",
          lambda spark, sf_dir: summarize(run_checks(spark, RUN_RULES, inputs(spark, sf_dir), as_of=AS_OF)).drop("run_id"),
          f"SELECT count(*) AS rules_executed, count(*) FILTER (status = 'PASS') AS passed, "
          f"count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errors FROM ({_RUN_SQL})")

_EVENT_TYPES = ("click", "purchase", "signup", "view")
THIRTY_RULES = RUN_RULES + (
    rule(13, "customer", "NOT_NULL", "c_name"),
    rule(14, "customer", "UNIQUE", "c_custkey"),
    rule(15, "customer", "ACCEPTED_VALUES", "c_mktsegment", {"values": ["BUILDING", "MACHINERY"]}),
    rule(16, "supplier", "RANGE", "s_acctbal", {"min": 0}, threshold=20.0),
    rule(17, "part", "NOT_NULL", "p_name"),
    rule(18, "part", "UNIQUE", "p_partkey"),
    rule(19, "part", "RANGE", "p_size", {"min": 1, "max": 40}, threshold=25.0),
    rule(20, "part", "RANGE", "p_retailprice", {"min": 950}),
    rule(21, "lineitem", "RANGE", "l_quantity", {"min": 1, "max": 45}, threshold=15.0),
    rule(22, "lineitem", "RANGE", "l_discount", {"max": 0.08}),
    rule(23, "lineitem", "ACCEPTED_VALUES", "l_returnflag", {"values": ["A", "N", "R"]}),
    rule(24, "lineitem", "REFERENTIAL", "l_partkey", {"ref_table": f"{DATABASE}.{SCHEMA}.part", "ref_column": "p_partkey"}),
    rule(25, "lineitem", "REFERENTIAL", "l_suppkey", {"ref_table": f"{DATABASE}.{SCHEMA}.supplier", "ref_column": "s_suppkey"}),
    rule(26, "orders", "RANGE", "o_totalprice", {"min": 1000}),
    rule(27, "orders", "FRESHNESS", "o_orderdate"),
    rule(28, "nation", "REFERENTIAL", "n_regionkey", {"ref_table": f"{DATABASE}.{SCHEMA}.region", "ref_column": "r_regionkey"}),
    rule(29, "events", "ACCEPTED_VALUES", "event_type", {"values": list(_EVENT_TYPES)}),
    rule(30, "events", "UNIQUE", "event_id"),
)
_THIRTY_SQL = _RUN_SQL + " UNION ALL " + " UNION ALL ".join([
    rows_where(13, "NOT_NULL", "c_name IS NULL", "customer"),
    repeated(14, "c_custkey", "customer"),
    rows_where(15, "ACCEPTED_VALUES", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "customer"),
    rows_where(16, "RANGE", "s_acctbal < 0", "supplier", 20.0),
    rows_where(17, "NOT_NULL", "p_name IS NULL", "part"),
    repeated(18, "p_partkey", "part"),
    rows_where(19, "RANGE", "p_size < 1 OR p_size > 40", "part", 25.0),
    rows_where(20, "RANGE", "p_retailprice < 950", "part"),
    rows_where(21, "RANGE", "l_quantity < 1 OR l_quantity > 45", "lineitem", 15.0),
    rows_where(22, "RANGE", "l_discount > 0.08::DOUBLE", "lineitem"),
    rows_where(23, "ACCEPTED_VALUES", "l_returnflag NOT IN ('A', 'N', 'R')", "lineitem"),
    orphaned(24, "l_partkey", "lineitem", "part", "p_partkey"),
    orphaned(25, "l_suppkey", "lineitem", "supplier", "s_suppkey"),
    rows_where(26, "RANGE", "o_totalprice < 1000", "orders"),
    verdict(27, "FRESHNESS", "1", f"CASE WHEN {FRESH_SQL.replace('ts', 'o_orderdate')} > 1440 THEN 1 ELSE 0 END", "orders"),
    orphaned(28, "n_regionkey", "nation", "region", "r_regionkey"),
    rows_where(29, "ACCEPTED_VALUES", "event_type NOT IN " + str(_EVENT_TYPES), "events"),
    repeated(30, "event_id", "events"),
])
_register("thirty_rules_run", _check(*THIRTY_RULES), _THIRTY_SQL)

BROKEN_RULES = (
    rule(1, "lineitem", "NOT_NULL", "no_such_column"),
    rule(2, "pages", "REGEX", "url", {"pattern": "(["}),
    rule(3, "events", "CUSTOM_SQL", None, {"failure_condition": "CAST(event_type AS INT) > 1"}),
    rule(4, "no_such_table", "ROW_COUNT", None, {"min": 1}),
    rule(5, "orders", "NO_SUCH_TYPE", "o_orderkey"),
    rule(6, "orders", "RANGE", "o_orderkey"),
    rule(7, "orders", "NOT_NULL", "o_orderkey", None, "this is no predicate"),
    rule(8, "events", "RANGE", "value", {"max": 100}),
    rule(9, "events", "NOT_NULL", "event_type"),
)
_register("run_error_isolation",
          lambda spark, sf_dir: run_checks(spark, BROKEN_RULES, inputs(spark, sf_dir), as_of=AS_OF).select(
              "rule_id", "total_rows", "failed_rows", "status"),
          "SELECT unnest([1, 2, 3, 4, 5, 6, 7])::BIGINT AS rule_id, NULL::BIGINT AS total_rows, NULL::BIGINT AS failed_rows, "
          "'ERROR' AS status UNION ALL SELECT 8, count(*), count(*) FILTER (value > 100), "
          "CASE WHEN count(*) FILTER (value > 100) > 0 THEN 'FAIL' ELSE 'PASS' END FROM events "
          "UNION ALL SELECT 9, count(*), count(*) FILTER (event_type IS NULL), 'PASS' FROM events")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview_rules(spark, RUN_RULES, inputs(spark, sf_dir), as_of=AS_OF)


_PREVIEW_SQL = (
    "SELECT rule_id, CASE WHEN failed_pct > threshold THEN 'FAIL' ELSE 'PASS' END AS status, failed_pct, failed_rows "
    "FROM (SELECT rule_id, failed_rows, CASE WHEN total_rows = 0 THEN 0.0 ELSE "
    "round(100.0::DOUBLE * failed_rows / total_rows, 2) END AS failed_pct, "
    "CASE rule_id WHEN 2 THEN 25 WHEN 4 THEN 50 WHEN 6 THEN 10 WHEN 12 THEN 60 ELSE 0 END AS threshold "
    f"FROM ({_RUN_SQL}))")
_register("rule_preview", lambda spark, sf_dir: _preview(spark, sf_dir).select("rule_id", "status", "failed_pct", "failed_rows"),
          _PREVIEW_SQL)
_register("preview_totals", lambda spark, sf_dir: preview_totals(_preview(spark, sf_dir)),
          f"SELECT count(*) FILTER (status = 'PASS') AS would_pass, count(*) FILTER (status = 'FAIL') AS would_fail, "
          f"count(*) FILTER (status = 'ERROR') AS errors FROM ({_PREVIEW_SQL})")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_rules(catalog(spark, sf_dir), table="lake.retail.orders").select(
        "rule_id", F.concat_ws(".", "database_name", "schema_name", "table_name").alias("table_fqn"), "rule_type")


_register("rule_selection", _selected, with_inputs(
    "SELECT rule_id, database_name || '.' || schema_name || '.' || table_name AS table_fqn, rule_type FROM rules "
    "WHERE is_active AND upper(database_name || '.' || schema_name || '.' || table_name) = 'LAKE.RETAIL.ORDERS'", "rules"))

# -- samples ----------------------------------------------------------------------------------------


def _sample(checked: Rule, *order_by: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failing_rows(compile_rule(checked, AS_OF), inputs(spark, sf_dir), order_by=order_by)
    return query


_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_register("sample_predicate",
          _sample(rule(1, "lineitem", "CUSTOM_SQL", None, {"failure_condition": "l_discount > l_tax"}, "l_quantity > 10"),
                  *_LINE_ORDER),
          f"SELECT * FROM lineitem WHERE l_quantity > 10 AND l_discount > l_tax ORDER BY {', '.join(_LINE_ORDER)} LIMIT 100")
_register("sample_unique", _sample(rule(2, "lineitem", "UNIQUE", "l_orderkey,l_linenumber"), *_LINE_ORDER[2:]),
          "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 "
          f"ORDER BY {', '.join(_LINE_ORDER)} LIMIT 100")
_register("sample_unique_hot_key", _sample(rule(2, "orders_open", "UNIQUE", "o_orderpriority"), "o_orderkey"),
          f"SELECT * FROM {O_OPEN} QUALIFY count(*) OVER (PARTITION BY o_orderpriority) > 1 "
          "ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 100")
_register("sample_referential", _sample(rule(3, "orders", "REFERENTIAL", "o_custkey", _REF), "o_orderkey"),
          f"SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {BUILDERS}) ORDER BY o_custkey, o_orderkey LIMIT 100")


def _stored_sample(checked: Rule, *keys: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows behind a recorded result, from the SQL stored with it. Which rows of the last key are shown
    is not fixed, so the query lists the keys."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = inputs(spark, sf_dir)
        results = run_checks(spark, [checked], known, as_of=AS_OF, run_id="run")
        return stored_sample(results, f"run:{checked.rule_id}", known).select(*keys)
    return query


_register("stored_sample_unique",
          _stored_sample(rule(6, "lineitem", "UNIQUE", "l_orderkey,l_linenumber"), "l_orderkey", "l_linenumber"),
          "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 "
          "ORDER BY l_orderkey, l_linenumber LIMIT 100")
_register("stored_sample_referential", _stored_sample(rule(7, "orders", "REFERENTIAL", "o_custkey", _REF), "o_custkey"),
          f"SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {BUILDERS}) ORDER BY o_custkey LIMIT 100")
_register("sample_freshness", _sample(rule(4, "events", "FRESHNESS", "ts", {"max_age_hours": 36})),
          f"SELECT max(ts) AS latest_value, date_diff('hour', max(ts), {AS_OF_SQL}) AS age_hours, "
          "36.0::DOUBLE AS max_age_hours FROM events")
_register("sample_row_count", _sample(rule(5, "lineitem", "ROW_COUNT", None, {"min": 1}, "l_returnflag = 'A'")),
          "SELECT count(*) AS row_count FROM lineitem WHERE l_returnflag = 'A'")
