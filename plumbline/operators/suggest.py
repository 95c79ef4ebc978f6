"""Rule suggestions from column profiles.

One projection turns each profile row into its candidate rules, so the profile is computed once
whatever the number of branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.text import contains_any, significant
from plumbline.model import DEFAULT_DIMENSION, REGEX_PRESETS, RULE_DIMENSIONS

# Name fragments and patterns of the heuristics.
REQUIRED_HINTS = ("_ID", "_DATE", "NAME", "STATUS", "AMOUNT", "TYPE")
NON_NEGATIVE_HINTS = ("AMOUNT", "BALANCE", "QTY", "QUANTITY", "PRICE", "BUDGET", "COST", "UNITS", "COUNT")
FRESHNESS_HINTS = ("LOADED", "UPDATED", "MODIFIED", "CREATED", "REFRESHED", "INGEST")
EMAIL_PATTERN = REGEX_PRESETS["Email"]
PHONE_PATTERN = r"^\+?[0-9\-\(\) ]{7,20}$"
FRESH_HOURS = 24
CONFIDENCE_SETS = {
    "high": ("high",),
    "medium": ("high", "medium"),
    "all": ("high", "medium", "low"),
    "none": (),
}


def parent_candidates(columns: DataFrame) -> DataFrame:
    """The best two parent tables per key column name: a table that starts with the column, else
    one whose name contains the entity; ties go to the first table name. Two suffice because a
    column only ever rules out its own table, so no pairs of tables are formed."""
    name = F.upper("column_name")
    named = F.upper("table_name").contains(F.expr("left(upper(column_name), length(column_name) - 3)"))
    is_first = F.col("ordinal_position") == 1
    held = columns.where(name.endswith("_ID")).select(
        name.alias("key_name"), F.col("table_name").alias("parent"),
        F.when(is_first, 0).when(named, 1).alias("choice"),
        F.when(is_first & named, "high").otherwise("medium").alias("parent_confidence"),
    ).where(F.col("choice").isNotNull())
    best = Window.partitionBy("key_name").orderBy("choice", "parent")
    return held.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2)


def find_parents(columns: DataFrame) -> DataFrame:
    """``(table_name, column_name, parent, parent_confidence)`` for the foreign-key-like columns of
    a schema: those named ``..._ID`` that do not come first in their table."""
    wanted = columns.where(F.upper("column_name").endswith("_ID") & (F.col("ordinal_position") > 1)).select(
        "table_name", "column_name", F.upper("column_name").alias("key_name"))
    matched = wanted.join(parent_candidates(columns), "key_name").where(F.col("parent") != F.col("table_name"))
    return matched.groupBy("table_name", "column_name").agg(
        F.min_by("parent", "place").alias("parent"),
        F.min_by("parent_confidence", "place").alias("parent_confidence"),
    )


def suggest_rules(profile: DataFrame, existing: DataFrame, columns: DataFrame, row_counts: DataFrame,
                  database: str, schema: str) -> DataFrame:
    """Candidate rules for the profiled tables, without those an active rule already covers.

    ``existing`` needs ``table_name, column_name, rule_type``; ``columns`` is the schema's column
    metadata and ``row_counts`` holds ``table_name, row_count``.
    """
    described = profile.join(find_parents(columns), ["table_name", "column_name"], "left")
    from_columns = described.select(
        F.explode(F.array_compact(F.array(*_column_candidates(database, schema)))).alias("c")).select("c.*")
    from_tables = row_counts.where(F.col("row_count") > 0).select(_volume_candidate().alias("c")).select("c.*")
    candidates = from_columns.unionByName(from_tables)

    covered = existing.select(
        F.col("table_name").alias("__t"), F.coalesce(F.upper("column_name"), F.lit("")).alias("__c"),
        F.upper("rule_type").alias("__r"),
    ).distinct()
    same = (
        (F.col("table_name") == F.col("__t"))
        & (F.coalesce(F.upper(candidates["column_name"]), F.lit("")) == F.col("__c"))
        & (F.col("rule_type") == F.col("__r"))
    )
    return candidates.join(covered, same, "left_anti")


def _candidate(kind: str, name: Column, description: Column, severity, threshold: float, confidence, reason: Column,
               params: Column | None = None, column: Column | None = None) -> Column:
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.col("table_name").alias("table_name"),
        (F.col("column_name") if column is None else column).alias("column_name"),
        F.lit(kind).alias("rule_type"),
        name.alias("rule_name"),
        description.alias("description"),
        (F.lit("{}") if params is None else F.to_json(params)).alias("rule_params"),
        text(severity).alias("severity"),
        F.lit(float(threshold)).alias("threshold_pct"),
        text(confidence).alias("confidence"),
        reason.alias("reason"),
    )


def _column_candidates(database: str, schema: str) -> list[Column]:
    say = lambda pattern, *args: F.format_string(pattern, *args)
    table, column, upper = F.col("table_name"), F.col("column_name"), F.upper("column_name")
    is_key = upper.endswith("_ID")
    is_pk = is_key & (F.col("ordinal_position") == 1)
    is_text = F.col("family") == "text"
    named = lambda ending: say(f"%s %s {ending}", table, column)

    unique_pct = F.col("uniqueness_pct")
    likely = unique_pct >= 99
    required = contains_any(upper, REQUIRED_HINTS)
    populated = ~is_pk & (F.col("total_rows") > 100) & (F.col("null_pct") == 0)

    values = F.col("values_list")
    first_values = F.concat(F.array_join(F.slice(values, 1, 6), ", "), F.when(F.size(values) > 6, "…").otherwise(""))

    lowest = F.expr("try_cast(min_value AS double)")
    non_negative = contains_any(upper, NON_NEGATIVE_HINTS)
    negative = (F.col("family") == "numeric") & (lowest < 0) & ~is_key

    age = F.col("age_hours")
    verdict = F.when(age > FRESH_HOURS, "would FAIL").otherwise("would PASS")
    fresh_reason = F.when(age.isNull(), "Load timestamp column").otherwise(
        say(f"Latest value %sh old — %s at {FRESH_HOURS}h", F.format_number(age, 1), verdict))
    fresh = (F.col("family") == "temporal") & contains_any(upper, FRESHNESS_HINTS)

    parent = F.col("parent")
    reference = F.struct(
        F.concat(F.lit(f"{database}.{schema}."), parent).alias("ref_table"), column.alias("ref_column"))

    return [
        F.when(is_pk, _candidate(
            "NOT_NULL", named("present"), say("Primary key %s must not be null", column), "CRITICAL", 0, "high",
            say("First column, %s%% nulls", F.col("null_pct").cast("string")))),
        F.when(is_pk, _candidate(
            "UNIQUE", named("unique"), say("Primary key %s must not repeat", column), "CRITICAL", 0,
            F.when(likely, "high").otherwise("medium"),
            say("%s%% unique%s", unique_pct.cast("string"),
                F.when(likely, " — likely PK").otherwise(" — duplicates present")))),
        F.when(is_key & ~is_pk & parent.isNotNull(), _candidate(
            "REFERENTIAL", say("%s %s references %s", table, column, parent), say("%s must exist in %s", column, parent),
            "HIGH", 0.1, F.col("parent_confidence"), say("Matches key column in %s", parent), reference)),
        F.when(populated, _candidate(
            "NOT_NULL", named("populated"), say("%s should not be null", column),
            F.when(required, "HIGH").otherwise("MEDIUM"), 0.5, F.when(required, "medium").otherwise("low"),
            F.when(required, "0% nulls and name implies required").otherwise("0% nulls"))),
        F.when((F.size(values) > 0) & ~is_key & is_text, _candidate(
            "ACCEPTED_VALUES", named("valid values"), say("%s must be one of the known values", column), "MEDIUM", 0,
            "medium", say("%s distinct values (full table): %s", F.size(values).cast("string"), first_values),
            F.struct(values.alias("values")))),
        F.when(negative, _candidate(
            "RANGE", named("non-negative"), say("%s should be >= 0", column),
            F.when(non_negative, "HIGH").otherwise("MEDIUM"), 1, F.when(non_negative, "medium").otherwise("low"),
            say("Min value %s%s", significant(lowest),
                F.when(non_negative, " — name implies non-negative").otherwise("")),
            F.struct(F.lit(0).alias("min")))),
        F.when(fresh, _candidate(
            "FRESHNESS", named("freshness"), say(f"%s should be refreshed within {FRESH_HOURS}h", column), "CRITICAL", 0,
            "high", fresh_reason, F.struct(F.lit(FRESH_HOURS).alias("max_age_hours")))),
        F.when(is_text & upper.contains("EMAIL"), _candidate(
            "REGEX", named("format"), say("%s must be a valid email address", column), "MEDIUM", 2, "medium",
            F.lit("Column name indicates email"), F.struct(F.lit(EMAIL_PATTERN).alias("pattern")))),
        F.when(is_text & upper.contains("PHONE"), _candidate(
            "REGEX", named("format"), say("%s must match a phone format", column), "LOW", 5, "medium",
            F.lit("Column name indicates phone"), F.struct(F.lit(PHONE_PATTERN).alias("pattern")))),
    ]


def _volume_candidate() -> Column:
    rows = F.col("row_count")
    bounds = F.struct(
        F.greatest(F.lit(1).cast("long"), (rows * F.lit(0.8)).cast("long")).alias("min"), (rows * 2).alias("max"))
    return _candidate(
        "ROW_COUNT", F.format_string("%s row count", "table_name"), F.lit("Row count within expected bounds"), "MEDIUM",
        0, "medium", F.format_string("Current %s rows; bounds 80%%–200%%", F.format_number(rows, 0)), bounds,
        F.lit(None).cast("string"))


def by_confidence(suggestions: DataFrame, mode: str = "high") -> DataFrame:
    return suggestions.where(F.col("confidence").isin(list(CONFIDENCE_SETS[mode])))


def to_catalog_rows(suggestions: DataFrame, database: str, schema: str, owner: str | None = None,
                    row_filter: str | None = None) -> DataFrame:
    """Suggestions as rule catalog rows without ids, with the default dimension of their type."""
    dimension = F.lit(DEFAULT_DIMENSION)
    for kind, name in RULE_DIMENSIONS.items():
        dimension = F.when(F.col("rule_type") == kind, name).otherwise(dimension)
    return suggestions.select(
        "rule_name", "description", F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"),
        "table_name", "column_name", "rule_type", "rule_params", F.lit(row_filter or None).cast("string").alias("row_filter"),
        "threshold_pct", "severity", dimension.alias("dimension"), F.lit(owner or None).cast("string").alias("owner"),
    )
