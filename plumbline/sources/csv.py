"""Rule catalogs and result lists as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.model import DEFAULT_DIMENSION, DEFAULT_SEVERITY, RULE_DIMENSIONS, RULE_EXPORT_COLUMNS
from plumbline.operators.reports import history_export

REQUIRED_COLUMNS = ("rule_name", "database_name", "schema_name", "table_name", "rule_type")
_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def export_rules(rules: DataFrame, path: str) -> None:
    rules.select(*RULE_EXPORT_COLUMNS).write.mode("overwrite").options(**_OPTIONS).csv(path)


def export_results(history: DataFrame, path: str) -> None:
    history_export(history).write.mode("overwrite").options(**_OPTIONS).csv(path)


def import_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from CSV files in the export layout (any column order, upper or lower case names).
    Missing required columns and unknown rule types reject the whole import."""
    raw = spark.read.options(**_OPTIONS, multiLine=True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    missing = [c for c in REQUIRED_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    given = raw.select(*[
        (F.col(f"`{names[c]}`") if c in names else F.lit(None)).cast("string").alias(c) for c in RULE_EXPORT_COLUMNS
    ])
    kind = F.upper("rule_type")
    unknown = given.where(kind.isNotNull() & ~kind.isin(list(RULE_DIMENSIONS))).select(kind.alias("t")).distinct()
    found = sorted(r["t"] for r in unknown.toLocalIterator())
    if found:
        raise ValueError(f"unknown rule types: {found}")
    return normalise_rules(given)


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Fill the defaults of the optional columns and upper-case types and severities."""
    filled = {
        "rule_params": F.coalesce("rule_params", F.lit("{}")),
        "threshold_pct": F.coalesce(F.col("threshold_pct").cast("double"), F.lit(0.0)),
        "severity": F.upper(F.coalesce("severity", F.lit(DEFAULT_SEVERITY))),
        "dimension": F.coalesce("dimension", F.lit(DEFAULT_DIMENSION)),
        "rule_type": F.upper("rule_type"),
    }
    return rules.select(*[filled.get(c, F.col(c)).alias(c) for c in RULE_EXPORT_COLUMNS])
