"""Schemas, enumerations and defaults of the rule catalog, the result history and the alert tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import types as T

# Enumerations, weights and defaults of the data model.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SEVERITY_WEIGHTS = {"CRITICAL": 8, "HIGH": 4, "MEDIUM": 2, "LOW": 1}
DIMENSIONS = ("Completeness", "Uniqueness", "Validity", "Consistency", "Timeliness", "Volume")
STATUSES = ("PASS", "FAIL", "ERROR")
TRIGGERS = ("SCHEDULE", "MANUAL", "BACKFILL")
NOTIFY_MODES = ("ALL_FAILURES", "NEW_FAILURES_ONLY")
CHANNELS = ("EMAIL", "WEBHOOK")
RULE_DIMENSIONS = {
    "NOT_NULL": "Completeness",
    "UNIQUE": "Uniqueness",
    "ACCEPTED_VALUES": "Validity",
    "RANGE": "Validity",
    "REGEX": "Validity",
    "FRESHNESS": "Timeliness",
    "ROW_COUNT": "Volume",
    "REFERENTIAL": "Consistency",
    "CUSTOM_SQL": "Consistency",
}
REGEX_PRESETS = {
    "Email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "US phone (+1-NNN-NNN-NNNN)": r"^\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}$",
    "US ZIP": r"^[0-9]{5}(-[0-9]{4})?$",
    "UUID": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "Alphanumeric code": r"^[A-Z0-9_-]+$",
}
DEFAULT_SEVERITY = "MEDIUM"
DEFAULT_DIMENSION = "Validity"
DEFAULT_SEVERITY_FILTER = "CRITICAL,HIGH"
DEFAULT_RETENTION_DAYS = 90
DEFAULT_MAX_AGE_HOURS = 24

RULE_EXPORT_COLUMNS = (
    "rule_name", "description", "database_name", "schema_name", "table_name", "column_name",
    "rule_type", "rule_params", "row_filter", "threshold_pct", "severity", "dimension", "owner",
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

RULES_SCHEMA = _schema(
    rule_id=_L, rule_name=_S, description=_S, database_name=_S, schema_name=_S, table_name=_S,
    column_name=_S, rule_type=_S, rule_params=_S, row_filter=_S, threshold_pct=_D, severity=_S,
    dimension=_S, owner=_S, is_active=_B, created_by=_S, created_at=_TS, updated_at=_TS,
)
RESULTS_SCHEMA = _schema(
    result_id=_S, run_id=_S, run_ts=_TS, rule_id=_L, rule_name=_S, table_fqn=_S, column_name=_S,
    rule_type=_S, dimension=_S, severity=_S, total_rows=_L, failed_rows=_L, failed_pct=_D,
    threshold_pct=_D, status=_S, error_message=_S, duration_ms=_L, check_sql=_S, sample_sql=_S,
    triggered_by=_S,
)
ALERT_POLICIES_SCHEMA = _schema(
    alert_id=_L, alert_name=_S, channel_type=_S, recipients=_S, severity_filter=_S, min_score=_D,
    is_enabled=_B, created_at=_TS, updated_at=_TS, notify_mode=_S, scope_tables=_S,
)
ALERT_HISTORY_SCHEMA = _schema(
    history_id=_S, alert_id=_L, alert_name=_S, channel_type=_S, recipients=_S, failures_count=_L,
    tables_affected=_S, message_preview=_S, status=_S, error_message=_S, sent_at=_TS,
)
SETTINGS_SCHEMA = _schema(setting_key=_S, setting_value=_S, updated_at=_TS)
MEASUREMENTS_SCHEMA = _schema(measured_at=_TS, table_fqn=_S, metric=_S, arguments=_S, value=_D)


@dataclass(frozen=True)
class Rule:
    """One row of the rule catalog. The catalog is configuration, so rules live on the driver."""

    rule_id: int
    rule_name: str
    database_name: str
    schema_name: str
    table_name: str
    rule_type: str
    column_name: str | None = None
    rule_params: Any = None
    row_filter: str | None = None
    threshold_pct: float | None = 0.0
    severity: str | None = DEFAULT_SEVERITY
    dimension: str | None = DEFAULT_DIMENSION
    owner: str | None = None
    description: str | None = None
    is_active: bool = True

    @classmethod
    def from_row(cls, row: Any) -> "Rule":
        values = row if isinstance(row, dict) else row.asDict()
        known = {f.name for f in fields(cls)}
        return cls(**{k.lower(): v for k, v in values.items() if k.lower() in known})

    @property
    def fqn(self) -> str:
        return f"{self.database_name}.{self.schema_name}.{self.table_name}"

    @property
    def type(self) -> str:
        return (self.rule_type or "").upper()

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in (self.column_name or "").split(",") if c.strip()]

    @property
    def params(self) -> dict:
        raw = self.rule_params
        if isinstance(raw, str):
            raw = json.loads(raw) if raw.strip() else {}
        return raw or {}
