"""Column profiles, signals and rule suggestions over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.profile import profile_kpis, profile_table, profile_tables, sampling_rate, with_rule_flag
from plumbline.operators.suggest import by_confidence, suggest_rules, to_catalog_rows
from plumbline.plans.workflow import apply_suggestions
from plumbline.sources.registry import Registry
from plumbline.sources.tables import RULES, Store
from plumbline.sources.workspace import work_folder
from workload.base import AS_OF, AS_OF_SQL, DATABASE, SCHEMA, TABLES, read, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Columns of the given tables with the family the profiler puts them in.
COLUMNS = {
    "orders": (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"),
               ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "text")),
    "events": (("event_id", "numeric"), ("ts", "temporal"), ("user_id", "numeric"), ("event_type", "text"),
               ("value", "numeric"), ("props", "text")),
    "documents": (("doc_id", "numeric"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "numeric")),
    "embeddings": (("vec_id", "numeric"), ("embedding", "complex"), ("label", "numeric")),
    "labels": (("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")),
    "conversations": (("conv_id", "numeric"), ("turn", "numeric"), ("role", "text"), ("text", "text")),
}
SHOWN = ("table_name", "column_name", "family", "ordinal_position", "total_rows", "null_count", "distinct_count",
         "min_value", "max_value", "age_hours", "sample_values", "sensitive", "null_pct", "uniqueness_pct",
         "values_list", "signals")

# A small shop over the given tables, named the way the suggestion heuristics look for. As
# (view, base table, columns as (name, expression, family)).
SHOP = (
    ("CUSTOMERS", "customer", (
        ("CUSTOMER_ID", "c_custkey", "numeric"), ("FULL_NAME", "c_name", "text"), ("EMAIL", "lower(c_name)", "text"),
        ("PHONE_NO", "c_name", "text"), ("SEGMENT", "c_mktsegment", "text"), ("BALANCE", "c_acctbal", "numeric"),
        ("DELTA", "c_acctbal", "numeric"), ("NATION_ID", "c_nationkey", "numeric"))),
    ("NATIONS", "nation", (
        ("NATION_ID", "n_nationkey", "numeric"), ("NATION_NAME", "n_name", "text"), ("REGION_ID", "n_regionkey", "numeric"))),
    ("ORDERS", "orders", (
        ("ORDER_ID", "o_orderkey", "numeric"), ("CUSTOMER_ID", "o_custkey", "numeric"),
        ("ORDER_STATUS", "o_orderstatus", "text"), ("AMOUNT", "o_totalprice", "numeric"),
        ("CREATED_AT", "o_orderdate", "temporal"), ("PRIORITY", "nullif(o_orderpriority, '4-NOT SPECIFIED')", "text"),
        ("USER_ID", "o_custkey", "numeric"))),
    ("ORDER_LINES", "lineitem", (
        ("ORDER_ID", "l_orderkey", "numeric"), ("PART_ID", "l_partkey", "numeric"), ("QUANTITY", "l_quantity", "numeric"),
        ("SHIPPED", "l_shipdate", "temporal"), ("FLAG", "l_returnflag", "text"))),
    ("USER_EVENTS", "events", (
        ("EVENT_ID", "event_id", "numeric"), ("USER_ID", "user_id", "numeric"), ("LOADED_AT", "ts", "temporal"),
        ("EVENT_TYPE", "event_type", "text"))),
)
SENSITIVE = {"FULL_NAME": "name suggests PII", "EMAIL": "name suggests PII", "PHONE_NO": "name suggests PII"}
EXISTING = (("ORDERS", "order_id", "UNIQUE"), ("ORDERS", None, "ROW_COUNT"), ("CUSTOMERS", "SEGMENT", "accepted_values"))


def shop(spark: SparkSession, sf_dir: str) -> Registry:
    known = Registry(spark)
    for view, base, columns in SHOP:
        known.register(f"{DATABASE}.{SCHEMA}.{view}", read(spark, sf_dir, base).select(
            *[F.expr(expression).alias(name) for name, expression, _ in columns]))
    return known


def shop_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = shop(spark, sf_dir)
    return profile_tables({view: known.resolve(f"{DATABASE}.{SCHEMA}.{view}") for view, _, _ in SHOP}, as_of=AS_OF)


def suggestions(spark: SparkSession, sf_dir: str, profile: DataFrame | None = None) -> DataFrame:
    known = shop(spark, sf_dir)
    existing = spark.createDataFrame(list(EXISTING), "table_name string, column_name string, rule_type string")
    profile = shop_profile(spark, sf_dir) if profile is None else profile
    counts = profile.groupBy("table_name").agg(F.max("total_rows").alias("row_count"))      # the profile knows them
    return suggest_rules(profile, existing, known.columns(), counts, DATABASE, SCHEMA)


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = shop_profile(spark, sf_dir)
    return profile_kpis(profile, suggestions(spark, sf_dir, profile))


# -- the same as SQL ------------------------------------------------------------------------------


def profile_sql(label: str, source: str, columns, sensitive: dict[str, str] | None = None) -> str:
    parts = []
    for position, (name, kind) in enumerate(columns, start=1):
        why = (sensitive or {}).get(name)
        readable = kind != "complex" and not why
        key = name.upper().endswith("_ID")
        low, high = (f"min({name})::VARCHAR", f"max({name})::VARCHAR") if readable else ("NULL::VARCHAR",) * 2
        listed = f"list_sort(list(DISTINCT {name}::VARCHAR) FILTER ({name} IS NOT NULL))"
        sample = f"coalesce(array_to_string({listed}[1:5], ', '), '')" if readable else "''"
        values = (f"CASE WHEN count(DISTINCT {name}) BETWEEN 1 AND 25 THEN {listed} END"
                  if readable and kind in ("text", "numeric") else "NULL::VARCHAR[]")
        age = f"date_diff('minute', max({name}), {AS_OF_SQL}) / 60.0::DOUBLE" if kind == "temporal" else "NULL::DOUBLE"
        tags = [f"'sensitive ({why})'" if why else "NULL"]
        tags.append("CASE WHEN uniqueness_pct >= 99 THEN 'PK?' ELSE 'FK?' END" if key else "NULL")
        tags.append("CASE WHEN len(values_list) > 0 THEN 'categorical' END")
        tags.append("'timestamp'" if kind == "temporal" else "NULL")
        tags.append("CASE WHEN null_pct > 5 THEN 'high nulls' END")
        tags.append("CASE WHEN TRY_CAST(min_value AS DOUBLE) < 0 THEN 'negatives' END" if kind == "numeric" else "NULL")
        parts.append(
            f"SELECT *, concat_ws(', ', {', '.join(tags)}) AS signals FROM ("
            f"SELECT '{label}' AS table_name, '{name}' AS column_name, '{kind}' AS family, {position} AS ordinal_position, "
            f"count(*) AS total_rows, count(*) FILTER ({name} IS NULL) AS null_count, "
            f"count(DISTINCT {name}) AS distinct_count, {low} AS min_value, {high} AS max_value, {age} AS age_hours, "
            f"{sample} AS sample_values, {repr(why) if why else 'NULL::VARCHAR'} AS sensitive, "
            f"round(100.0::DOUBLE * count(*) FILTER ({name} IS NULL) / greatest(count(*), 1), 2) AS null_pct, "
            f"round(100.0::DOUBLE * count(DISTINCT {name}) / greatest(count(*), 1), 2) AS uniqueness_pct, "
            f"{values} AS values_list FROM {source})")
    return " UNION ALL ".join(parts)


def _shop_source(base: str, columns) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e, _ in columns) + f" FROM {base})"


SHOP_PROFILE_SQL = " UNION ALL ".join(
    profile_sql(view, _shop_source(base, columns), [(n, k) for n, _, k in columns], SENSITIVE)
    for view, base, columns in SHOP)

for _table in ("orders", "events", "documents", "embeddings", "conversations"):
    QUERIES[f"profile_{_table}"] = (
        lambda spark, sf_dir, table=_table: profile_table(read(spark, sf_dir, table), table, as_of=AS_OF).select(*SHOWN))
    ORACLE[f"profile_{_table}"] = profile_sql(_table, _table, COLUMNS[_table])

QUERIES["categorical_values"] = lambda spark, sf_dir: profile_tables(
    {t: read(spark, sf_dir, t) for t in ("orders", "documents", "labels")}, as_of=AS_OF).where(
        "values_list IS NOT NULL").select("table_name", "column_name", F.explode("values_list").alias("value"))
ORACLE["categorical_values"] = (
    "SELECT table_name, column_name, unnest(values_list) AS value FROM ("
    + " UNION ALL ".join(profile_sql(t, t, COLUMNS[t]) for t in ("orders", "documents", "labels")) + ")")
QUERIES["sensitive_guard"] = lambda spark, sf_dir: shop_profile(spark, sf_dir).select(*SHOWN)
ORACLE["sensitive_guard"] = SHOP_PROFILE_SQL


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = spark.createDataFrame([(*e, True) for e in EXISTING],
                                     "table_name string, column_name string, rule_type string, is_active boolean")
    return with_rule_flag(shop_profile(spark, sf_dir), existing).select("table_name", "column_name", "total_rows", "has_rule")


QUERIES["profile_has_rule"] = _flagged
ORACLE["profile_has_rule"] = (
    "SELECT table_name, column_name, total_rows, (table_name, column_name) IN "
    f"(('ORDERS', 'ORDER_ID'), ('CUSTOMERS', 'SEGMENT')) AS has_rule FROM ({SHOP_PROFILE_SQL})")

# -- samples ----------------------------------------------------------------------------------------


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentage a profile of about 1,000 rows would sample, from the tables' row counts."""
    counts = registry(spark, sf_dir).row_counts()
    return counts.select("table_name", "row_count", sampling_rate(F.col("row_count"), 1000).alias("sample_pct"))


QUERIES["sampling_rates"] = _rates
ORACLE["sampling_rates"] = (
    "SELECT table_name, row_count, CASE WHEN row_count > 1000 THEN greatest(0.1, ceil(1000.0 * 1000 / row_count) / 10)::DOUBLE END "
    "AS sample_pct FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES) + ")")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables stored as many files and profiled on a tenth: what a sample may not exceed, beside the exact figures."""
    parts = []
    for table in ("orders", "events"):
        path = work_folder(spark, "many-files")
        read(spark, sf_dir, table).repartition(40).write.parquet(path)
        frame = spark.read.parquet(path)
        exact = profile_table(frame, table, as_of=AS_OF).drop("sampled_pct")
        part = profile_table(frame, table, as_of=AS_OF, sample_pct=10.0).select(
            "column_name", F.col("total_rows").alias("seen"), F.col("distinct_count").alias("found"), "sampled_pct", F.col("null_count").alias("nulls"))
        parts.append(exact.join(part, "column_name").select(
            "table_name", "column_name", "total_rows", "null_count",
            ((F.col("seen") > 0) & (F.col("seen") < 0.5 * F.col("total_rows"))).alias("fewer_rows"),
            ((F.col("sampled_pct") > 0) & (F.abs(100 * F.col("seen") / F.col("total_rows") - F.col("sampled_pct")) < 2)).alias("pct_tells"),
            ((F.col("found") <= F.col("distinct_count")) & (F.col("nulls") <= F.col("null_count"))).alias("within")))
    return parts[0].unionByName(parts[1])


QUERIES["profile_sampled"] = _sampled
ORACLE["profile_sampled"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER ({c} IS NULL) AS null_count, "
    f"true AS fewer_rows, true AS pct_tells, true AS within FROM {t}" for t in ("orders", "events") for c, _ in COLUMNS[t])

# -- suggestions ------------------------------------------------------------------------------------

_COLUMN_ROWS = ", ".join(
    f"('{view}', '{name}', {position})"
    for view, _, columns in SHOP for position, (name, _, _) in enumerate(columns, start=1))
_COUNT_ROWS = " UNION ALL ".join(f"SELECT '{view}' AS table_name, count(*) AS row_count FROM {base}" for view, base, _ in SHOP)


def _any(column: str, fragments: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{f}')" for f in fragments.split()) + ")"


_REQUIRED = _any("column_name", "_ID _DATE NAME STATUS AMOUNT TYPE")
_POSITIVE = _any("column_name", "AMOUNT BALANCE QTY QUANTITY PRICE BUDGET COST UNITS COUNT")
_FRESH = _any("column_name", "LOADED UPDATED MODIFIED CREATED REFRESHED INGEST")
_T, _C = "table_name || ' ' || column_name", "column_name"


def _branch(where: str, kind: str, name: str, description: str, params: str, severity: str, threshold: float,
            confidence: str, reason: str, source: str = "prof", column: str = "column_name") -> str:
    return (f"SELECT table_name, {column} AS column_name, '{kind}' AS rule_type, {name} AS rule_name, "
            f"{description} AS description, {params} AS rule_params, {severity} AS severity, "
            f"{threshold}::DOUBLE AS threshold_pct, {confidence} AS confidence, {reason} AS reason "
            f"FROM {source} WHERE {where}")


_KEY, _PK = "ends_with(column_name, '_ID')", "ends_with(column_name, '_ID') AND ordinal_position = 1"
_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
_PHONE = r"^\+?[0-9\-\(\) ]{7,20}$"
SUGGEST_SQL = f"""
WITH prof AS ({SHOP_PROFILE_SQL}),
cols(table_name, column_name, ordinal_position) AS (VALUES {_COLUMN_ROWS}),
counts AS ({_COUNT_ROWS}),
held AS (SELECT column_name AS key, table_name AS parent, ordinal_position = 1 AS first,
                contains(table_name, left(column_name, length(column_name) - 3)) AS named FROM cols WHERE {_KEY}),
parents AS (SELECT c.table_name, c.column_name, h.parent,
                   CASE WHEN h.first AND h.named THEN 'high' ELSE 'medium' END AS parent_confidence
            FROM cols c JOIN held h ON h.key = c.column_name AND h.parent <> c.table_name AND (h.first OR h.named)
            WHERE c.ordinal_position > 1
            QUALIFY row_number() OVER (PARTITION BY c.table_name, c.column_name ORDER BY h.first DESC, h.parent) = 1),
candidates AS (
{_branch(_PK, "NOT_NULL", _T + " || ' present'", "'Primary key ' || column_name || ' must not be null'", "'{}'",
         "'CRITICAL'", 0, "'high'", "'First column, ' || null_pct || '% nulls'")}
UNION ALL {_branch(_PK, "UNIQUE", _T + " || ' unique'", "'Primary key ' || column_name || ' must not repeat'", "'{}'",
                   "'CRITICAL'", 0, "CASE WHEN uniqueness_pct >= 99 THEN 'high' ELSE 'medium' END",
                   "uniqueness_pct || '% unique' || CASE WHEN uniqueness_pct >= 99 THEN ' — likely PK' "
                   "ELSE ' — duplicates present' END")}
UNION ALL {_branch("true", "REFERENTIAL", _T + " || ' references ' || parent", "column_name || ' must exist in ' || parent",
                   f"to_json({{'ref_table': '{DATABASE}.{SCHEMA}.' || parent, 'ref_column': column_name}})::VARCHAR",
                   "'HIGH'", 0.1, "parent_confidence", "'Matches key column in ' || parent", "parents")}
UNION ALL {_branch(f"total_rows > 100 AND null_pct = 0 AND NOT ({_PK})", "NOT_NULL", _T + " || ' populated'",
                   "column_name || ' should not be null'", "'{}'", f"CASE WHEN {_REQUIRED} THEN 'HIGH' ELSE 'MEDIUM' END",
                   0.5, f"CASE WHEN {_REQUIRED} THEN 'medium' ELSE 'low' END",
                   f"'0% nulls' || CASE WHEN {_REQUIRED} THEN ' and name implies required' ELSE '' END")}
UNION ALL {_branch(f"len(values_list) > 0 AND NOT {_KEY} AND family = 'text'", "ACCEPTED_VALUES", _T + " || ' valid values'",
                   "column_name || ' must be one of the known values'", "to_json({'values': values_list})::VARCHAR",
                   "'MEDIUM'", 0, "'medium'",
                   "len(values_list) || ' distinct values (full table): ' || array_to_string(values_list[1:6], ', ') || "
                   "CASE WHEN len(values_list) > 6 THEN '…' ELSE '' END")}
UNION ALL {_branch(f"family = 'numeric' AND TRY_CAST(min_value AS DOUBLE) < 0 AND NOT {_KEY}", "RANGE",
                   _T + " || ' non-negative'", "column_name || ' should be >= 0'",
                   "'{\"min\":0}'", f"CASE WHEN {_POSITIVE} THEN 'HIGH' ELSE 'MEDIUM' END", 1,
                   f"CASE WHEN {_POSITIVE} THEN 'medium' ELSE 'low' END",
                   "'Min value ' || printf('%g', TRY_CAST(min_value AS DOUBLE)) || "
                   f"CASE WHEN {_POSITIVE} THEN ' — name implies non-negative' ELSE '' END")}
UNION ALL {_branch(f"family = 'temporal' AND {_FRESH}", "FRESHNESS", _T + " || ' freshness'",
                   "column_name || ' should be refreshed within 24h'", "'{\"max_age_hours\":24}'", "'CRITICAL'", 0, "'high'",
                   "'Latest value ' || format('{:,}', round(age_hours * 10)::BIGINT // 10) || '.' || "
                   "(round(age_hours * 10)::BIGINT % 10) || 'h old — ' || "
                   "CASE WHEN age_hours > 24 THEN 'would FAIL' ELSE 'would PASS' END || ' at 24h'")}
UNION ALL {_branch("family = 'text' AND contains(column_name, 'EMAIL')", "REGEX", _T + " || ' format'",
                   "column_name || ' must be a valid email address'", f"to_json({{'pattern': '{_EMAIL}'}})::VARCHAR",
                   "'MEDIUM'", 2, "'medium'", "'Column name indicates email'")}
UNION ALL {_branch("family = 'text' AND contains(column_name, 'PHONE')", "REGEX", _T + " || ' format'",
                   "column_name || ' must match a phone format'", f"to_json({{'pattern': '{_PHONE}'}})::VARCHAR",
                   "'LOW'", 5, "'medium'", "'Column name indicates phone'")}
UNION ALL {_branch("row_count > 0", "ROW_COUNT", "table_name || ' row count'", "'Row count within expected bounds'",
                   "'{\"min\":' || greatest(1, floor(row_count * 0.8::DOUBLE)::BIGINT) || ',\"max\":' || row_count * 2 || '}'",
                   "'MEDIUM'", 0, "'medium'",
                   "'Current ' || format('{:,}', row_count) || ' rows; bounds 80%–200%'", "counts", "NULL::VARCHAR")}
)
SELECT * FROM candidates WHERE (table_name, coalesce(column_name, ''), rule_type) NOT IN
  (('ORDERS', 'ORDER_ID', 'UNIQUE'), ('ORDERS', '', 'ROW_COUNT'), ('CUSTOMERS', 'SEGMENT', 'ACCEPTED_VALUES'))
"""
QUERIES["suggest_rules"] = suggestions
ORACLE["suggest_rules"] = SUGGEST_SQL
QUERIES["suggest_confident"] = lambda spark, sf_dir: to_catalog_rows(
    by_confidence(suggestions(spark, sf_dir), "medium"), DATABASE, SCHEMA, owner="Data Engineering").select(
        "rule_name", "table_name", "column_name", "rule_type", "threshold_pct", "severity", "dimension", "owner")
ORACLE["suggest_confident"] = (
    "SELECT rule_name, table_name, column_name, rule_type, threshold_pct, severity, CASE rule_type WHEN 'NOT_NULL' THEN "
    "'Completeness' WHEN 'UNIQUE' THEN 'Uniqueness' WHEN 'FRESHNESS' THEN 'Timeliness' WHEN 'ROW_COUNT' THEN 'Volume' "
    "WHEN 'REFERENTIAL' THEN 'Consistency' ELSE 'Validity' END AS dimension, 'Data Engineering' AS owner "
    f"FROM ({SUGGEST_SQL}) WHERE confidence IN ('high', 'medium')")


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confident suggestions added to an empty catalog, and all of them run at once: a result for each rule."""
    store = Store(spark, work_folder(spark, "applied"))
    apply_suggestions(store, shop(spark, sf_dir), by_confidence(suggestions(spark, sf_dir), "medium"), DATABASE, SCHEMA, as_of=AS_OF)
    results = store.newest_results().select("rule_id", "total_rows", "status")
    whole = F.col("rule_type").isin("NOT_NULL", "UNIQUE")
    return store.rows(RULES).join(results, "rule_id", "left").select(
        "rule_name", "table_name", "column_name", "rule_type", "severity", F.when(whole, F.col("total_rows")).alias("total_rows"),
        F.col("status").isNotNull().alias("ran"), F.when(F.col("rule_type") == "NOT_NULL", F.col("status")).alias("present"))


QUERIES["suggestions_applied"] = _applied
ORACLE["suggestions_applied"] = (
    "SELECT rule_name, table_name, column_name, rule_type, severity, CASE WHEN rule_type IN ('NOT_NULL', 'UNIQUE') THEN c.row_count END AS total_rows, "
    f"true AS ran, CASE WHEN rule_type = 'NOT_NULL' THEN 'PASS' END AS present FROM ({SUGGEST_SQL}) JOIN ({_COUNT_ROWS}) c USING (table_name) "
    "WHERE confidence IN ('high', 'medium')")
QUERIES["profile_kpis"] = _kpis
ORACLE["profile_kpis"] = (
    "SELECT count(DISTINCT table_name) AS tables_profiled, count(*) AS columns, "
    f"count(*) FILTER (null_pct > 5) AS high_null_columns, (SELECT count(*) FROM ({SUGGEST_SQL})) AS suggestions "
    f"FROM ({SHOP_PROFILE_SQL})")
