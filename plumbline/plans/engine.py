"""Evaluate many rules in few passes.

All rules on one (table, row filter) that a scan can answer share one aggregate; uniqueness and
referential rules get one aggregation each. Each of these groups is a Spark job of its own and a
few run at a time, so a failing rule costs its group another try, not the whole run. Only one row
per rule comes back to the driver.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.model import RESULTS_SCHEMA, Rule
from plumbline.operators.checks import Check, compile_rule, count_duplicates, count_orphans
from plumbline.sources.parallel import CONCURRENT_JOBS, side_by_side
from plumbline.sources.registry import Registry

# Error conditions that speak of the cluster rather than of data.
CLUSTER_CONDITIONS = ("INTERNAL_ERROR", "UNABLE_TO_ACQUIRE_MEMORY", "JOB_CANCELLED", "OPERATION_CANCELED", "FAILED_READ_FILE",
                      "CONNECT", "TASK_WRITE_FAILED")

# Beyond 100 fields Spark gives up whole-stage code generation, so one aggregate stays below that.
MAX_FUSED = 80

_MEASURED = T.StructType([
    *[f for f in RESULTS_SCHEMA.fields if f.name not in ("failed_pct", "status", "result_id")],
])


def active_rules(rules: DataFrame, table: str | None = None, rule_id: int | None = None) -> DataFrame:
    """Active rules, optionally of one table (any case) and with one id; both conditions apply."""
    chosen = rules.where(F.col("is_active"))
    if table:
        fqn = F.concat_ws(".", "database_name", "schema_name", "table_name")
        chosen = chosen.where(F.upper(fqn) == table.upper())
    if rule_id is not None:
        chosen = chosen.where(F.col("rule_id") == int(rule_id))
    return chosen


def select_rules(rules: DataFrame, table: str | None = None, rule_id: int | None = None) -> list[Rule]:
    """The same as configuration, in id order: a plan is compiled from them on the driver."""
    return [Rule.from_row(row) for row in active_rules(rules, table, rule_id).orderBy("rule_id").toLocalIterator()]


def group_checks(checks: Mapping[int, Check]) -> list[list[int]]:
    """Positions of checks that one job answers together."""
    scans: dict[tuple[str, str | None], list[int]] = defaultdict(list)
    groups = []
    for position, check in checks.items():
        if check.failed is None:
            groups.append([position])
        else:
            scans[check.fqn.upper(), check.row_filter].append(position)
    for positions in scans.values():
        groups += [positions[i:i + MAX_FUSED] for i in range(0, len(positions), MAX_FUSED)]
    return groups


def measure(checks: Mapping[int, Check], registry: Registry) -> DataFrame:
    """``(position, total_rows, failed_rows)`` of any checks as one lazy plan."""
    frames = []
    for positions in group_checks(checks):
        first = checks[positions[0]]
        if first.failed is not None:
            frames.append(_fused({p: checks[p] for p in positions}, registry))
            continue
        source = first.source(registry)
        if first.keys:
            counts = count_duplicates(source, first.keys)
        else:
            parent = registry.resolve(first.rule.params["ref_table"])
            counts = count_orphans(source, first._column, parent, first.parent[1])
        frames.append(counts.select(F.lit(positions[0]).alias("position"), "total_rows", "failed_rows"))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _fused(group: Mapping[int, Check], registry: Registry) -> DataFrame:
    measured = ", ".join(
        f"named_struct('position', {position}, 'total_rows', CAST({check.total} AS BIGINT), "
        f"'failed_rows', CAST({check.failed} AS BIGINT))"
        for position, check in group.items()
    )
    return next(iter(group.values())).source(registry).agg(F.expr(f"array({measured})").alias("m")).select(F.inline("m"))


def run_checks(
    spark: SparkSession,
    rules: DataFrame | Iterable[Rule],
    registry: Registry,
    *,
    table: str | None = None,
    rule_id: int | None = None,
    triggered_by: str | None = "MANUAL",
    as_of: datetime | None = None,
    run_id: str | None = None,
    fuse: bool = True,
) -> DataFrame:
    """Evaluate rules and return one result row per rule. A rule that cannot be compiled, analysed
    or executed becomes an ``ERROR`` row and never stops the others.

    ``duration_ms`` is the time of the Spark job a rule ran in divided by the rules in that job.
    """
    chosen = select_rules(rules, table, rule_id) if isinstance(rules, DataFrame) else list(rules)
    as_of = as_of or datetime.now(timezone.utc)
    run_id = run_id or str(uuid.uuid4())

    checks: dict[int, Check] = {}
    outcomes: dict[int, Outcome] = {}
    for position, rule in enumerate(chosen):
        try:
            checks[position] = compile_rule(rule, as_of)
        except Exception as problem:  # noqa: BLE001 - any bad rule is reported, not raised
            outcomes[position] = Outcome(error=_message(problem))

    groups = group_checks(checks) if fuse else [[p] for p in checks]
    jobs = CONCURRENT_JOBS if fuse else 1
    for found in side_by_side(spark, lambda g: _evaluate({p: checks[p] for p in g}, registry), groups, jobs):
        outcomes.update(found)

    trigger = (triggered_by or "MANUAL").upper()
    rows = []
    for position, rule in enumerate(chosen):
        check, outcome = checks.get(position), outcomes[position]
        rows.append((
            run_id, as_of, rule.rule_id, rule.rule_name, rule.fqn.upper(), rule.column_name, rule.rule_type,
            rule.dimension, rule.severity, outcome.total, outcome.failed, _float(rule.threshold_pct), outcome.error,
            outcome.took_ms, check.check_sql() if check else None, check.sample_sql() if check else None, trigger,
        ))
    return judge(spark.createDataFrame(rows, _MEASURED))


@dataclass(frozen=True)
class Outcome:
    total: int | None = None
    failed: int | None = None
    error: str | None = None
    took_ms: int = 0


def _evaluate(checks: dict[int, Check], registry: Registry) -> dict[int, Outcome]:
    """Count one group. Rules Spark cannot plan are set aside first, without reading data. When the
    job itself fails, the group is halved until the rules to blame are alone: one bad rule among n
    costs about 2 log n further jobs of this group, not n."""
    started = time.monotonic()
    outcomes: dict[int, Outcome] = {}
    plan = _plan(checks, registry)
    if plan is None:
        for position, check in checks.items():
            problem = _planning_problem(check, registry)
            if problem:
                outcomes[position] = Outcome(error=problem, took_ms=_ms(started))
        checks = {p: c for p, c in checks.items() if p not in outcomes}
        if not checks:
            return outcomes
        plan = measure(checks, registry)
    try:
        measured = plan.collect()
    except Exception as problem:  # noqa: BLE001
        if not blames_data(problem):
            raise
        positions = list(checks)
        if len(positions) == 1:
            return {**outcomes, positions[0]: Outcome(error=_message(problem), took_ms=_ms(started))}
        middle = len(positions) // 2
        for half in (positions[:middle], positions[middle:]):
            outcomes.update(_evaluate({p: checks[p] for p in half}, registry))
        return outcomes
    share = _ms(started) // len(checks)
    for row in measured:
        outcomes[row["position"]] = Outcome(int(row["total_rows"] or 0), int(row["failed_rows"] or 0), None, share)
    return outcomes


def blames_data(problem: Exception) -> bool:
    """Whether a job failed over values or expressions: Spark then names an error condition for it. Lost
    executors, exhausted memory and cancelled jobs name none, or one of the cluster's own."""
    condition = problem.getCondition() if isinstance(problem, PySparkException) else None
    return bool(condition) and not condition.startswith(CLUSTER_CONDITIONS)


def _plan(checks: dict[int, Check], registry: Registry) -> DataFrame | None:
    try:
        if any(check.probe for check in checks.values()):
            probes = ", ".join(check.probe for check in checks.values() if check.probe)
            registry.spark.sql(f"SELECT {probes}").collect()  # folded to constants, starts no job
        plan = measure(checks, registry)
        plan.schema
        return plan
    except Exception:  # noqa: BLE001 - some rule is to blame; the caller asks them one by one
        return None


def _planning_problem(check: Check, registry: Registry) -> str | None:
    """Why Spark cannot plan a rule: unknown table or column, type mismatch, broken predicate or
    pattern."""
    try:
        if check.probe:
            registry.spark.sql(f"SELECT {check.probe}").collect()
        measure({0: check}, registry).schema
        return None
    except Exception as problem:  # noqa: BLE001
        return _message(problem)


def failed_pct(places: int = 4) -> Column:
    total, failed = F.col("total_rows"), F.col("failed_rows")
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * failed / F.nullif(total, F.lit(0)), places))


def status_of(pct: Column) -> Column:
    return (
        F.when(F.col("error_message").isNotNull(), "ERROR")
        .when(pct > F.coalesce(F.col("threshold_pct"), F.lit(0.0)), "FAIL")
        .otherwise("PASS")
    )


def judge(measured: DataFrame, places: int = 4) -> DataFrame:
    """Add the failing percentage (rounded before the comparison), the status and the result id."""
    judged = (
        measured.withColumn("failed_pct", failed_pct(places))
        .withColumn("status", status_of(F.col("failed_pct")))
        .withColumn("result_id", F.concat_ws(":", "run_id", F.col("rule_id").cast("string")))
    )
    return judged.select(*RESULTS_SCHEMA.names)


def stored_sample(results: DataFrame, result_id: str, registry: Registry) -> DataFrame:
    """The failing rows behind a stored result, from the sample SQL recorded with it; works for
    rules that were edited or deleted since."""
    row = results.where(F.col("result_id") == result_id).select("sample_sql").first()
    if row is None or not row["sample_sql"]:
        raise ValueError(f"no sample is stored for result {result_id!r}")
    return registry.sql(row["sample_sql"])


def summarize(results: DataFrame) -> DataFrame:
    """One row per run: rules executed and how they ended."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rules_executed"),
        *[F.count_if(F.col("status") == s).alias(name)
          for s, name in (("PASS", "passed"), ("FAIL", "failed"), ("ERROR", "errors"))],
    )


def preview_rules(
    spark: SparkSession, rules: Iterable[Rule], registry: Registry, *, as_of: datetime | None = None,
    round_to: int = 2,
) -> DataFrame:
    """What the rules would report, without saving."""
    measured = run_checks(spark, list(rules), registry, as_of=as_of, run_id="preview")
    pct = failed_pct(round_to)
    return measured.select(
        "rule_id",
        status_of(pct).alias("status"),
        F.col("rule_name").alias("rule"),
        F.element_at(F.split("table_fqn", r"\."), -1).alias("table_name"),
        pct.alias("failed_pct"),
        "threshold_pct",
        "failed_rows",
        F.col("error_message").alias("error"),
    )


def preview_totals(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count_if(F.col("status") == "PASS").alias("would_pass"),
        F.count_if(F.col("status") == "FAIL").alias("would_fail"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
    )


def _message(problem: Exception) -> str:
    return str(problem)


def _ms(started: float) -> int:
    return int((time.monotonic() - started) * 1000)


def _float(value) -> float | None:
    return None if value is None else float(value)
