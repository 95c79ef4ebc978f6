"""Rule checks: what a rule counts, which rows it blames, and how both read as Spark SQL.

A check is compiled once into SQL expression text. The engine evaluates that text inside fused
aggregates and the history stores it. For uniqueness and references the stored SQL spells out the plan
that the engine builds with the DataFrame API: keys are reduced before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import (
    full_match, grouping_key, number_literal, quote, quote_fqn, string_literal, timestamp_literal,
)
from plumbline.functions.time import boundary_difference_sql
from plumbline.model import DEFAULT_MAX_AGE_HOURS, RULE_DIMENSIONS, Rule
from plumbline.sources.registry import Registry

SAMPLE_ROWS = 100


@dataclass(frozen=True)
class Check:
    """A compiled rule. ``failed`` and ``total`` are aggregate expressions for the rules one scan
    can answer; ``keys`` is set for uniqueness and ``parent`` for referential checks."""

    rule: Rule
    total: str = "count(*)"
    failed: str | None = None
    failing_row: str | None = None
    detail: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    probe: str | None = None  # constant expression that fails where the rule's pattern is invalid

    @property
    def fqn(self) -> str:
        return self.rule.fqn

    @property
    def row_filter(self) -> str | None:
        return self.rule.row_filter or None

    def source(self, registry: Registry) -> DataFrame:
        frame = registry.resolve(self.fqn)
        return frame.where(F.expr(f"({self.row_filter})")) if self.row_filter else frame

    # -- display text -------------------------------------------------------------------------

    def _from(self, *conditions: str) -> str:
        parts = [f"({self.row_filter})"] if self.row_filter else []
        parts += [f"({c})" for c in conditions]
        return f"FROM {quote_fqn(self.fqn)}" + (" WHERE " + " AND ".join(parts) if parts else "")

    def check_sql(self) -> str:
        if self.keys:
            key = ", ".join(self.keys)
            return (f"SELECT coalesce(sum(n), 0) AS total_rows, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS failed_rows "
                    f"FROM (SELECT count(*) AS n {self._from()} GROUP BY {key})")
        if self.parent:
            table, column = self.parent
            return (f"SELECT coalesce(sum(n), 0) AS total_rows, "
                    f"coalesce(sum(n) FILTER (WHERE fk IS NOT NULL AND ref IS NULL), 0) AS failed_rows "
                    f"FROM (SELECT {self._column} AS fk, count(*) AS n {self._from()} GROUP BY 1) "
                    f"LEFT JOIN (SELECT DISTINCT {column} AS ref FROM {table}) ON fk = ref")
        return f"SELECT {self.total} AS total_rows, {self.failed} AS failed_rows {self._from()}"

    def sample_sql(self) -> str:
        if self.keys:
            key = ", ".join(self.keys)
            order = ", ".join(f"{k} NULLS LAST" for k in self.keys)
            match = " AND ".join(f"t.{k} <=> d.{k}" for k in self.keys)
            return (f"SELECT t.* FROM (SELECT * {self._from()}) t LEFT SEMI JOIN (SELECT {key} {self._from()} "
                    f"GROUP BY {key} HAVING count(*) > 1 ORDER BY {order} LIMIT {SAMPLE_ROWS}) d ON {match} "
                    f"ORDER BY {order} LIMIT {SAMPLE_ROWS}")
        if self.parent:
            table, column = self.parent
            fk = self._column
            return (f"SELECT t.* FROM (SELECT * {self._from()}) t LEFT SEMI JOIN (SELECT c.fk FROM "
                    f"(SELECT DISTINCT {fk} AS fk {self._from(fk + ' IS NOT NULL')}) c "
                    f"LEFT ANTI JOIN (SELECT DISTINCT {column} AS ref FROM {table}) p ON c.fk = p.ref "
                    f"ORDER BY c.fk LIMIT {SAMPLE_ROWS}) d ON t.{fk} = d.fk ORDER BY t.{fk} LIMIT {SAMPLE_ROWS}")
        if self.detail:
            return f"SELECT {', '.join(self.detail)} {self._from()}"
        return f"SELECT * {self._from(self.failing_row or 'TRUE')} LIMIT {SAMPLE_ROWS}"

    @property
    def _column(self) -> str:
        return quote(self.rule.columns[0])


# -- one small function per rule type -----------------------------------------------------------


def _rows(rule: Rule, predicate: str) -> Check:
    return Check(rule, failed=f"count_if({predicate})", failing_row=predicate)


def _not_null(rule: Rule, as_of: datetime) -> Check:
    return _rows(rule, f"{_first(rule)} IS NULL")


def _unique(rule: Rule, as_of: datetime) -> Check:
    _first(rule)
    return Check(rule, keys=tuple(quote(c) for c in rule.columns))


def _accepted_values(rule: Rule, as_of: datetime) -> Check:
    column, values = _first(rule), _required(rule, "values")
    accepted = ", ".join(string_literal(v) for v in values)
    return _rows(rule, f"{column} IS NOT NULL AND CAST({column} AS STRING) NOT IN ({accepted})")


def _range(rule: Rule, as_of: datetime) -> Check:
    column = _first(rule)
    low, high = _bounds(rule)
    outside = []
    if low is not None:
        outside.append(f"{column} < {_bound_literal(low)}")
    if high is not None:
        outside.append(f"{column} > {_bound_literal(high)}")
    return _rows(rule, " OR ".join(outside))


def _regex(rule: Rule, as_of: datetime) -> Check:
    column, pattern = _first(rule), _required(rule, "pattern")
    whole = string_literal(full_match(pattern))
    predicate = f"{column} IS NOT NULL AND NOT CAST({column} AS STRING) RLIKE {whole}"
    return replace(_rows(rule, predicate), probe=f"'' RLIKE {whole}")


def _freshness(rule: Rule, as_of: datetime) -> Check:
    newest = f"max({_first(rule)})"
    minutes = int(float(rule.params.get("max_age_hours", DEFAULT_MAX_AGE_HOURS)) * 60)
    clock = timestamp_literal(as_of)
    age = boundary_difference_sql("MINUTE", clock, newest)
    return Check(
        rule,
        total="1",
        failed=f"CASE WHEN {newest} IS NULL OR {age} > {minutes} THEN 1 ELSE 0 END",
        detail=(f"{newest} AS latest_value",
                f"{boundary_difference_sql('HOUR', clock, newest)} AS age_hours",
                f"{minutes / 60!r}D AS max_age_hours"),
    )


def _row_count(rule: Rule, as_of: datetime) -> Check:
    low, high = _bounds(rule)
    outside = []
    if low is not None:
        outside.append(f"count(*) < {int(low)}")
    if high is not None:
        outside.append(f"count(*) > {int(high)}")
    return Check(rule, total="1", failed=f"CASE WHEN {' OR '.join(outside)} THEN 1 ELSE 0 END",
                 detail=("count(*) AS row_count",))


def _referential(rule: Rule, as_of: datetime) -> Check:
    _first(rule)
    return Check(rule, parent=(quote_fqn(_required(rule, "ref_table")), quote(_required(rule, "ref_column"))))


def _custom_sql(rule: Rule, as_of: datetime) -> Check:
    return _rows(rule, f"({_required(rule, 'failure_condition')})")


COMPILERS: dict[str, Callable[[Rule, datetime], Check]] = {
    "NOT_NULL": _not_null,
    "UNIQUE": _unique,
    "ACCEPTED_VALUES": _accepted_values,
    "RANGE": _range,
    "REGEX": _regex,
    "FRESHNESS": _freshness,
    "ROW_COUNT": _row_count,
    "REFERENTIAL": _referential,
    "CUSTOM_SQL": _custom_sql,
}
assert COMPILERS.keys() == RULE_DIMENSIONS.keys()


def compile_rule(rule: Rule, as_of: datetime) -> Check:
    """Validate a rule and compile it; an invalid rule raises ``ValueError``."""
    compiler = COMPILERS.get(rule.type)
    if compiler is None:
        raise ValueError(f"Unknown rule type {rule.type!r}")
    return compiler(rule, as_of)


def _first(rule: Rule) -> str:
    if not rule.columns:
        raise ValueError(f"{rule.type} needs column_name")
    return quote(rule.columns[0])


def _required(rule: Rule, name: str):
    value = rule.params.get(name)
    if not value:
        raise ValueError(f"{rule.type} needs the parameter {name!r}")
    return value


def _bounds(rule: Rule):
    low, high = rule.params.get("min"), rule.params.get("max")
    if low is None and high is None:
        raise ValueError(f"{rule.type} needs the parameter 'min' or 'max'")
    return low, high


def _bound_literal(value: object) -> str:
    """Numbers as they are; ISO dates and timestamps for temporal columns."""
    try:
        return number_literal(value)
    except (TypeError, ValueError):
        text = str(value)
    try:
        if len(text) == 10:
            return f"DATE '{date.fromisoformat(text)}'"
        return timestamp_literal(datetime.fromisoformat(text))
    except ValueError:
        raise ValueError(f"bound {text!r} is neither a number nor an ISO date") from None


# -- counting what one scan cannot answer ---------------------------------------------------------


def count_duplicates(source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows and rows in repeated key groups, in one pass. Partial aggregation collapses a hot key
    before the shuffle; NULL keys group together and can repeat."""
    groups = source.groupBy(*[grouping_key(source, k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed_rows"),
    )


def count_orphans(source: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows and non-null foreign keys without a parent. The child is reduced to one row per key
    before the join, so neither a hot key nor the NULL keys can fill one task; both sides arrive
    hash-partitioned on the join key from their aggregation and need no further shuffle."""
    child = source.groupBy(F.expr(column).alias("fk")).agg(F.count(F.lit(1)).alias("n"))
    known = (parent.select(F.expr(parent_column).alias("ref")).where(F.col("ref").isNotNull())
             .distinct().withColumn("found", F.lit(True)))
    orphan = F.col("fk").isNotNull() & F.col("found").isNull()
    return child.join(known, F.col("fk") == F.col("ref"), "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("failed_rows"),
    )


# -- samples ----------------------------------------------------------------------------------------


def failing_rows(check: Check, registry: Registry, limit: int = SAMPLE_ROWS, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Example rows behind a failed check. Uniqueness and referential samples come in key order;
    ``order_by`` makes any sample deterministic."""
    source = check.source(registry)
    if check.detail:
        return source.agg(*[F.expr(d) for d in check.detail])
    order = [F.expr(c).asc_nulls_last() for c in order_by]
    if check.keys:
        counted = _keyed(source, check.keys).agg(F.count(F.lit(1)).alias("__n"))
        return _rows_of_first_keys(source, check.keys, counted.where("__n > 1").drop("__n"), order, limit)
    if check.parent:
        parent = registry.resolve(check.rule.params["ref_table"])
        known = parent.select(F.expr(check.parent[1]).alias("__ref")).distinct()
        fk = check._column
        keys = _keyed(source.where(F.expr(f"{fk} IS NOT NULL")), (fk,)).agg(F.lit(1).alias("__one")).drop("__one")
        orphans = keys.join(known, keys["__key0"] == known["__ref"], "left_anti")
        return _rows_of_first_keys(source, (fk,), orphans, order, limit)
    rows = source.where(F.expr(check.failing_row))
    return (rows.orderBy(*order) if order else rows).limit(limit)


def _keyed(source: DataFrame, keys: tuple[str, ...]):
    return source.groupBy(*[F.expr(k).alias(f"__key{i}") for i, k in enumerate(keys)])


def _rows_of_first_keys(source: DataFrame, keys: tuple[str, ...], failing: DataFrame, order: list, limit: int) -> DataFrame:
    """Rows of the first failing keys. Every key owns a row, so ``limit`` keys are enough: that
    side is broadcast by construction, and the rows of a hot key meet a top-n, not a shuffle."""
    names = [f"__key{i}" for i in range(len(keys))]
    first = failing.select(*names).orderBy(*[F.col(n).asc_nulls_last() for n in names]).limit(limit)
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & source[key].eqNullSafe(first[name])
    in_key_order = [F.expr(k).asc_nulls_last() for k in keys]
    return source.join(F.broadcast(first), same, "left_semi").orderBy(*in_key_order, *order).limit(limit)
