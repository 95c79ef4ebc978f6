"""Alert policies: which failures each policy reports, and the text it would send.

Policies are configuration, like rules, so a few of them are compiled into predicates on the driver: each
failure is tested against all policies in one pass and emits a row per policy it matches. Many policies, or a DataFrame
of any number of them, become an index: their different scopes are resolved once per table, by the literal beginning of
each pattern, and failures find their policies by table and severity, so that the cost of a failure does not grow with
the policies it doesn't match. The rows are pairs: they grow with failures times policies that match, and only they do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from plumbline.functions.scores import severity_rank
from plumbline.functions.text import (
    fixed, full_match, glob_body, glob_prefix, in_scope, listed_severities, scope_patterns, timestamp_literal,
)
from plumbline.model import (
    ALERT_HISTORY_SCHEMA, ALERT_POLICIES_SCHEMA, CHANNELS, DEFAULT_RETENTION_DAYS,
)
from plumbline.operators.scoring import latest_results, previous_results, table_health

# Limits and texts of the notifications.
RECENT_HOURS = 6
MESSAGE_LINES = 25
FEW_POLICIES = 64             # up to which one expression tests them all
CHUNK = 4096                  # policies that meet the failures of a table and severity in one task
LAST_EVALUATION_MINUTES = 5
NO_MATCH = "No matching failures"
NO_NEW = "No new failures since previous run"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

Policies = Sequence[Row] | DataFrame


def select_policies(policies: DataFrame, alert_id: int | None = None) -> list[Row]:
    """One policy by id (enabled or not), or all enabled ones in id order."""
    chosen = policies.where(F.col("is_enabled") if alert_id is None else F.col("alert_id") == int(alert_id))
    return chosen.select(*ALERT_POLICIES_SCHEMA.names).orderBy("alert_id").collect()


def current_failures(results: DataFrame, rules: DataFrame, as_of: datetime, test: bool = False) -> DataFrame:
    """Latest results that do not pass, from the last six hours unless testing. A result that is
    the latest of all is also the latest of the window, so only the window is read."""
    if not test:
        cutoff = as_of - timedelta(hours=RECENT_HOURS)
        results = results.where(F.col("run_ts") > F.expr(timestamp_literal(cutoff)))
        if "run_date" in results.columns:
            results = results.where(F.col("run_date") >= F.lit(cutoff.date()))
    return latest_results(results, rules).where(F.col("status") != "PASS")


def _new_only(policy: Row) -> bool:
    return (policy["notify_mode"] or "ALL_FAILURES").upper() == "NEW_FAILURES_ONLY"


def _per_policy(rows: DataFrame, matches: Sequence[tuple[int, Column]]) -> DataFrame:
    """Repeat a row once for every policy whose predicate it satisfies."""
    ids = F.array_compact(F.array(*[F.when(matched, F.lit(alert_id).cast("long")) for alert_id, matched in matches]))
    return rows.withColumn("alert_id", F.explode(ids))


def policy_frame(policies: DataFrame, alert_id: int | None = None) -> DataFrame:
    """What ``select_policies`` chooses, as a DataFrame: for any number of policies, none of which reaches the driver."""
    chosen = policies.where(F.col("is_enabled") if alert_id is None else F.col("alert_id") == int(alert_id))
    return chosen.select(*ALERT_POLICIES_SCHEMA.names)


def _as_frame(spark: SparkSession, policies: Policies) -> DataFrame:
    if isinstance(policies, DataFrame):
        return policies
    return spark.createDataFrame([tuple(p[name] for name in ALERT_POLICIES_SCHEMA.names) for p in policies], ALERT_POLICIES_SCHEMA)


def _many(policies: Policies) -> bool:
    return isinstance(policies, DataFrame) or len(policies) > FEW_POLICIES


def _parsed(policies: DataFrame, column: str, read: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """(``column``, ...): the rows ``read`` makes of each different text of the column."""
    def task(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.bool_() if c.endswith(" boolean") else pa.string() for c in schema.split(", ")]
        for batch in batches:
            found = [(text, *row) for text in batch.column(0).to_pylist() for row in read(text)]
            columns = zip(*found) if found else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, (pa.string(), *kinds))], names=[column, *names])

    return policies.select(column).distinct().mapInArrow(task, f"{column} string, {schema}")


def scope_index(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """``(__table, scope_tables)``: the policies' different scopes that each different table is in.

    A pattern is found by its literal beginning, which is a beginning of the table's name, and checked from
    there: tables and patterns meet by an equi-join on beginnings."""
    def patterns(scope):
        rows = []
        for pattern in dict.fromkeys(scope_patterns(scope)):
            prefix = glob_prefix(pattern)
            rest = pattern[len(prefix):]
            rows.append((prefix, rest == "", None if rest in ("", "*") else full_match(glob_body(pattern)), False))
        return rows or [("", False, None, True)]

    index = _parsed(policies, "scope_tables", patterns, "__prefix string, __whole boolean, __regex string, __any boolean")
    name = F.upper("__table")
    known = tables.select(F.col("table_fqn").alias("__table")).distinct()
    length = F.coalesce(F.length(name), F.lit(0))
    starts = known.select("__table", F.explode(F.transform(
        F.sequence(F.lit(0), length), lambda n: F.coalesce(F.substring(name, F.lit(1), n), F.lit("")))).alias("__prefix"))
    fits = ~F.col("__whole") | (F.length("__table") == F.length("__prefix"))
    checked = F.col("__regex").isNull() | F.expr("rlike(upper(__table), __regex)")
    found = starts.join(index, "__prefix").where(F.col("__any") | (F.col("__table").isNotNull() & fits & checked))
    return found.select("__table", "scope_tables").distinct()


def _in_scope_of(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """The policies with every ``__table`` in their scope."""
    found = scope_index(tables, policies).withColumnRenamed("scope_tables", "__scope")
    known = policies.where(F.col("alert_id").isNotNull())
    return known.join(found, F.col("scope_tables").eqNullSafe(F.col("__scope"))).drop("__scope")


def _met(judged: DataFrame, targets: DataFrame) -> DataFrame:
    """``judged`` (with ``__modes``, an array) once for each ``alert_id`` of ``targets`` (``__table``, ``__severity``, ``__new``)
    that has its table, its severity and one of its modes.

    A few tables and severities may hold most policies and failures. The policies of each are dealt over chunks of
    about ``CHUNK``, and the failures go to every chunk, so that no task holds them all."""
    keys = ("__table", "__severity", "__new")
    chunks = targets.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__chunks"))

    def same(left, right, *columns):
        matched = [left[f"__l{c}"].eqNullSafe(right[c]) if c == "__table" else left[f"__l{c}"] == right[c] for c in columns]
        return left.join(right, matched).drop(*columns)

    asked = judged.withColumns({"__l__table": F.col("table_fqn"), "__l__severity": F.col("severity"), "__l__new": F.explode("__modes")})
    spread = same(asked, chunks, *keys).withColumn("__l__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)))
    renamed = targets.withColumnsRenamed({c: f"__l{c}" for c in keys})
    dealt = same(renamed, chunks, *keys).withColumn("__chunk", F.pmod(F.xxhash64("alert_id"), "__chunks")).select(
        *(F.col(f"__l{c}").alias(c) for c in keys), "__chunk", "alert_id")
    return same(spread, dealt, *keys, "__chunk").select(*(c for c in judged.columns if c != "__modes"), "alert_id")


def matched_failures(failures: DataFrame, results: DataFrame, policies: Policies, test: bool = False) -> DataFrame:
    """``alert_id`` with the failures its severities, scope and mode select. A failure is new when
    the result before it passed or does not exist; the history is only read if a policy asks."""
    if test or not (isinstance(policies, DataFrame) or any(_new_only(p) for p in policies)):
        judged = failures.withColumn("previous_status", F.lit(None).cast("string"))
    else:
        before = previous_results(results).select("rule_id", F.col("status").alias("previous_status"))
        judged = failures.join(before, "rule_id", "left")
    is_new = F.col("previous_status").isNull() | (F.col("previous_status") == "PASS")
    if _many(policies):
        frame = _as_frame(judged.sparkSession, policies)
        wanted = _parsed(frame, "severity_filter", lambda text: [(s,) for s in listed_severities(text)], "__severity string").withColumnRenamed(
            "severity_filter", "__filter")
        new = F.lit(False) if test else F.coalesce(F.upper("notify_mode") == "NEW_FAILURES_ONLY", F.lit(False))
        targets = _in_scope_of(judged.select("table_fqn"), frame).join(
            wanted, F.col("severity_filter").eqNullSafe(F.col("__filter"))).select("__table", "__severity", new.alias("__new"), "alert_id")
        return _met(judged.withColumn("__modes", F.when(is_new, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))), targets)
    matches = []
    for policy in policies:
        wanted = F.col("severity").isin(listed_severities(policy["severity_filter"])) & in_scope(F.col("table_fqn"), policy["scope_tables"])
        matches.append((policy["alert_id"], wanted & is_new if _new_only(policy) and not test else wanted))
    return _per_policy(judged, matches)


def low_score_tables(health: DataFrame, policies: Policies) -> DataFrame:
    """``alert_id`` with the tables in scope whose score is below the policy's minimum."""
    chosen = health.select("table_fqn", "dq_score")
    if _many(policies):
        scored = _as_frame(chosen.sparkSession, policies).where(F.col("min_score").isNotNull())
        asked = _in_scope_of(chosen, scored).select("__table", F.col("min_score").cast("double").alias("__least"), "alert_id")
        found = chosen.join(asked, F.col("table_fqn").eqNullSafe(F.col("__table")))
        return found.where(F.col("dq_score") < F.col("__least")).select("table_fqn", "dq_score", "alert_id")
    matches = [
        (p["alert_id"], (F.col("dq_score") < float(p["min_score"])) & in_scope(F.col("table_fqn"), p["scope_tables"]))
        for p in policies if p["min_score"] is not None
    ]
    if not matches:
        return chosen.where(F.lit(False)).withColumn("alert_id", F.lit(0).cast("long"))
    return _per_policy(chosen, matches)


def _percent(value: Column) -> Column:
    return F.coalesce(F.concat(fixed(value, 2), F.lit("%")), F.lit("-"))


def _failure_lines(matched: DataFrame) -> DataFrame:
    """Per policy: number of failures, tables affected, and the first lines of the message. Only
    ``MESSAGE_LINES`` rows per policy and input partition pass the shuffle for the lines, and one
    per policy and table for the rest."""
    line = F.concat(
        F.lit("- ["), F.coalesce("severity", F.lit("None")), F.lit("] "), F.coalesce("rule_name", F.lit("None")),
        F.lit(" on "), F.coalesce("table_fqn", F.lit("None")), F.lit(": "), _percent(F.col("failed_pct")),
        F.lit(" failed (threshold "), _percent(F.col("threshold_pct")), F.lit(")"),
    )
    rank = F.coalesce(severity_rank(F.col("severity")), F.lit(3))
    slim = matched.select("alert_id", "table_fqn", rank.alias("rank"), "rule_name", "rule_id", line.alias("line"))
    in_order = Window.partitionBy("alert_id").orderBy("rank", "table_fqn", "rule_name", "rule_id")
    first = slim.withColumn("rn", F.row_number().over(in_order)).where(F.col("rn") <= MESSAGE_LINES)
    lines = first.groupBy("alert_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda e: e["line"]).alias("lines"))
    per_table = matched.groupBy("alert_id", "table_fqn").agg(F.count(F.lit(1)).alias("n"))
    counts = per_table.groupBy("alert_id").agg(
        F.sum("n").alias("failures_count"),
        F.array_join(F.array_sort(F.collect_list("table_fqn")), ", ").alias("tables_affected"))
    return counts.join(lines, "alert_id")


def _low_line(low: DataFrame) -> DataFrame:
    item = F.concat(F.col("table_fqn"), F.lit(" ("), fixed(F.col("dq_score"), 1), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("table_fqn", item.alias("item"))))
    return low.groupBy("alert_id").agg(F.array_join(F.transform(listed, lambda e: e["item"]), ", ").alias("low_tables"))


def evaluate_alerts(
    spark: SparkSession,
    results: DataFrame,
    rules: DataFrame,
    policies: Policies,
    as_of: datetime,
    *,
    app_url: str = "",
    test: bool = False,
) -> DataFrame:
    """One alert history row per policy, plus the full ``message``. Nothing is sent: a policy with
    something to report is ``READY``, one without is ``SKIPPED``."""
    matched = matched_failures(current_failures(results, rules, as_of, test), results, policies, test)

    config = _as_frame(spark, policies).select(
        "alert_id", "alert_name", "channel_type", "recipients", F.col("min_score").cast("double").alias("min_score"),
        F.coalesce(F.upper("notify_mode") == "NEW_FAILURES_ONLY", F.lit(False)).alias("new_only"))
    evaluated = config.join(_failure_lines(matched), "alert_id", "left")
    if isinstance(policies, DataFrame) or any(p["min_score"] is not None for p in policies):
        low = low_score_tables(table_health(latest_results(results, rules)), policies)
        evaluated = evaluated.join(_low_line(low), "alert_id", "left")
    else:
        evaluated = evaluated.withColumn("low_tables", F.lit(None).cast("string"))

    count = F.coalesce("failures_count", F.lit(0).cast("long"))
    nothing = F.col("failures_count").isNull() & F.col("low_tables").isNull()
    heading = F.format_string(("[TEST] " if test else "") + "Data Quality Alert: %d check(s) failed", count)
    more = F.when(count > MESSAGE_LINES, F.format_string("... and %d more", count - MESSAGE_LINES))
    below = F.when(F.col("low_tables").isNotNull(), F.concat(
        F.lit("Tables below score "), fixed(F.col("min_score"), 0), F.lit(": "), "low_tables"))
    link = F.lit(f"Open the app: {app_url}" if app_url else None).cast("string")
    message = F.concat_ws("\n", heading, "lines", more, below, link)
    channel = F.upper(F.coalesce("channel_type", F.lit("")))
    known = channel.isin(list(CHANNELS))
    skipped = F.when(F.col("new_only"), NO_NEW).otherwise(NO_MATCH)

    clock = timestamp_literal(as_of)
    return evaluated.select(
        F.concat_ws(":", F.date_format(F.expr(clock), "yyyyMMddHHmmssSSSSSS"), F.col("alert_id").cast("string")).alias("history_id"),
        "alert_id", "alert_name", "channel_type", "recipients",
        count.alias("failures_count"),
        F.when(~nothing, F.coalesce("tables_affected", F.lit(""))).alias("tables_affected"),
        F.when(nothing, skipped).otherwise(message).alias("message_preview"),
        F.when(nothing, "SKIPPED").when(known, "READY").otherwise("FAILED").alias("status"),
        F.when(~nothing & ~known, F.concat(F.lit("Unknown channel type: "), channel)).alias("error_message"),
        F.expr(clock).alias("sent_at"),
        F.when(~nothing, message).alias("message"),
    )


def to_history(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(*ALERT_HISTORY_SCHEMA.names)


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# -- history ------------------------------------------------------------------------------------


def notification_history(history: DataFrame, names: Sequence[str] = (), statuses: Sequence[str] = (),
                         limit: int | None = None) -> DataFrame:
    """The notifications that match all given filters; a listing may ask for the newest ``limit`` of them."""
    rows = history
    if names:
        rows = rows.where(F.col("alert_name").isin(list(names)))
    if statuses:
        rows = rows.where(F.col("status").isin(list(statuses)))
    return rows if limit is None else rows.orderBy(F.col("sent_at").desc(), F.col("history_id").desc()).limit(limit)


def notification_kpis(history: DataFrame) -> DataFrame:
    return history.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "SENT", "FAILED", "SKIPPED")],
        F.max("sent_at").alias("latest"),
    )


def last_evaluation(history: DataFrame) -> DataFrame:
    """Counts per status within five minutes of the newest notification. Of a log with day folders, only the
    newest day and the one before are read; which one is the newest, ``Store.newest_days`` knows without a scan."""
    if "sent_date" in history.columns:
        day = history.agg(F.max("sent_date")).scalar()
        history = history.where(F.col("sent_date") >= F.date_sub(day, 1))
    newest = history.agg(F.max("sent_at")).scalar()
    start = newest - F.expr(f"INTERVAL {LAST_EVALUATION_MINUTES} MINUTES")
    return history.where(F.col("sent_at") >= start).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.max("sent_at").alias("at"))


def retention_days(settings: DataFrame) -> DataFrame:
    """One row: the retention setting, or 90 where it is missing or not a number."""
    value = F.max(F.expr("try_cast(setting_value AS decimal(38,0))"))
    return settings.where(F.col("setting_key") == "ALERT_HISTORY_RETENTION_DAYS").agg(
        F.coalesce(value.cast("int"), F.lit(DEFAULT_RETENTION_DAYS)).alias("days"))


def retained_history(history: DataFrame, settings: DataFrame, as_of: datetime) -> DataFrame:
    """The history without notifications older than the retention setting."""
    days = retention_days(settings).scalar()
    cutoff = F.expr(timestamp_literal(as_of)) - F.make_dt_interval(days)
    return history.where(F.col("sent_at") >= cutoff)


# -- policies -----------------------------------------------------------------------------------


def policy_problems(policies: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Per policy: malformed addresses, addresses outside the allowed list, and what else keeps the
    policy from being saved."""
    addresses = F.filter(F.transform(F.split("recipients", ","), lambda a: F.trim(a)), lambda a: a != "")
    is_email = F.upper("channel_type") == "EMAIL"
    malformed = F.filter(addresses, lambda a: ~a.rlike(EMAIL_PATTERN))
    known = F.array(*[F.lit(a.lower()) for a in allowed])
    blocked = F.filter(addresses, lambda a: a.rlike(EMAIL_PATTERN) & ~F.array_contains(known, F.lower(a)))
    none = F.array().cast("array<string>")
    severities = F.filter(F.transform(F.split("severity_filter", ","), lambda s: F.trim(s)), lambda s: s != "")
    no_severity = F.coalesce(F.size(severities), F.lit(0)) < 1
    problems = F.array_compact(F.array(
        F.when(is_email & (F.size(malformed) > 0),
               F.concat(F.lit("fix malformed addresses: "), F.array_join(malformed, ", "))),
        F.when(F.coalesce(F.trim("recipients"), F.lit("")) == "", F.lit("set recipients")),
        F.when(no_severity & F.col("min_score").isNull(), F.lit("pick a severity or a score threshold")),
        F.when(F.coalesce(F.trim("alert_name"), F.lit("")) == "", F.lit("name the policy")),
    ))
    return policies.select(
        "alert_id",
        F.when(is_email, malformed).otherwise(none).alias("malformed"),
        F.when(is_email & F.lit(bool(allowed)), blocked).otherwise(none).alias("not_allowed"),
        F.array_join(problems, "; ").alias("problems"),
        (F.size(problems) == 0).alias("is_valid"),
    )


def scope_options(rules: DataFrame) -> DataFrame:
    """Everything a policy can be scoped to: each table with rules, and each whole schema."""
    schema = F.concat_ws(".", "database_name", "schema_name")
    tables = rules.select(F.concat_ws(".", schema, "table_name").alias("scope"))
    schemas = rules.select(F.concat(schema, F.lit(".*")).alias("scope"))
    return tables.union(schemas).distinct()
