"""The framework's own tables as parquet under one shared root.

History tables are append-only and partitioned by day; retention is a recorded cutoff, and days before it
are dropped. Keyed tables (rules, policies, settings) take several writers: a change adds a folder
with the new versions of rows, a delete one with markers, each by a commit of its own, and reading
keeps the newest version per key. The two newest results of every rule are kept beside the history, so that
current views need no day of it, and so are counts per day, table, dimension, severity and status, so that trends
need no result. Nothing is rewritten in place, so a lost executor or a failed job can
never leave a half-changed table.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions.text import timestamp_literal
from plumbline.model import (
    ALERT_HISTORY_SCHEMA, ALERT_POLICIES_SCHEMA, DEFAULT_DIMENSION, DEFAULT_SEVERITY, DEFAULT_SEVERITY_FILTER,
    MEASUREMENTS_SCHEMA, RESULTS_SCHEMA, RULES_SCHEMA, SETTINGS_SCHEMA, DEFAULT_RETENTION_DAYS,
)
from plumbline.operators.alerts import retention_days
from plumbline.operators.scoring import ROLLUP_SCHEMA, daily_rollup
from plumbline.sources.commits import ATTEMPTS, CommitLog, Version


@dataclass(frozen=True)
class Log:
    name: str
    schema: T.StructType
    moment: str
    partition: str


@dataclass(frozen=True)
class Keyed:
    name: str
    schema: T.StructType
    key: str


RESULTS = Log("results", RESULTS_SCHEMA, "run_ts", "run_date")
ALERT_HISTORY = Log("alert_history", ALERT_HISTORY_SCHEMA, "sent_at", "sent_date")
MEASUREMENTS = Log("measurements", MEASUREMENTS_SCHEMA, "measured_at", "measured_date")
RULES = Keyed("rules", RULES_SCHEMA, "rule_id")
POLICIES = Keyed("alert_policies", ALERT_POLICIES_SCHEMA, "alert_id")
SETTINGS = Keyed("settings", SETTINGS_SCHEMA, "setting_key")
NEWEST_RESULTS = Keyed("newest_results", RESULTS_SCHEMA, "rule_id")     # up to two rows per key
DAILY_ROLLUP = Keyed("daily_rollup", T.StructType([
    T.StructField("day", T.StringType()), T.StructField("digest", T.StringType()), *ROLLUP_SCHEMA.fields]), "day")     # many rows per key
NO_DAY = "none"               # the key of results without a moment

COMPACT_AFTER = 32            # commits since a snapshot

RULE_DEFAULTS = {"rule_params": "{}", "threshold_pct": 0.0, "severity": DEFAULT_SEVERITY,
                 "dimension": DEFAULT_DIMENSION, "is_active": True}
POLICY_DEFAULTS = {"severity_filter": DEFAULT_SEVERITY_FILTER, "is_enabled": True, "notify_mode": "ALL_FAILURES"}
SETTING_DEFAULTS = {"APP_URL": "", "ALERT_HISTORY_RETENTION_DAYS": str(DEFAULT_RETENTION_DAYS)}


# -- pure operators on keyed frames ---------------------------------------------------------------


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str], insert_only: bool = False) -> DataFrame:
    """Matched rows take the values of ``updates`` (or stay, with ``insert_only``), unmatched ones
    are inserted. Columns that ``updates`` lacks are kept."""
    marked = updates.withColumn("__matched", F.lit(True))
    joined = target.alias("t").join(marked.alias("u"), list(keys), "full_outer")
    changed = F.col("__matched") if not insert_only else F.col("__matched") & F.col("__known").isNull()
    if insert_only:
        joined = target.withColumn("__known", F.lit(True)).alias("t").join(marked.alias("u"), list(keys), "full_outer")
    columns = []
    for name in target.columns:
        if name in keys or name not in updates.columns:
            columns.append(F.col(name if name in keys else f"t.{name}").alias(name))
        else:
            columns.append(F.when(changed, F.col(f"u.{name}")).otherwise(F.col(f"t.{name}")).alias(name))
    return joined.select(*columns)


def delete_rows(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys), list(keys), "left_anti")


def changed_rows(current: DataFrame, edited: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The edited rows that differ from the current ones in any column, compared as text."""
    differs = F.lit(False)
    for name in columns:
        differs = differs | ~F.col(f"e.{name}").cast("string").eqNullSafe(F.col(f"c.{name}").cast("string"))
    joined = edited.alias("e").join(current.alias("c"), F.col(f"e.{key}") == F.col(f"c.{key}"))
    return joined.where(differs).select("e.*")


# -- the store ------------------------------------------------------------------------------------


def newest_two(results: DataFrame) -> DataFrame:
    """The two newest results per rule; of a rule's rows, each input partition shuffles two."""
    newest = Window.partitionBy("rule_id").orderBy(F.col("run_ts").desc(), F.col("result_id").desc())
    return results.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= 2).drop("__rn")


class Store:
    """Reads and writes the framework tables under ``root``, a path every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _log(self, table: Log | Keyed) -> CommitLog:
        return CommitLog(self.spark, self._path(table.name))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _days(self, log: Log) -> list[str]:
        """The names of a log's day folders, sorted."""
        fs, target = self._fs(self._path(log.name))
        if not fs.exists(target):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(target)]
        return sorted(n for n in names if n.startswith(f"{log.partition}="))

    def _repeat(self, log: CommitLog, attempt: Callable[[Version], bool]) -> None:
        """Try on the newest version until no other writer was first."""
        for k in range(ATTEMPTS):
            if attempt(log.current()):
                return
            time.sleep(min(0.01 * k, 1))
        raise RuntimeError(f"other writers kept changing {log.path}")

    # -- history tables

    def append(self, log: Log, frame: DataFrame) -> None:
        """Append by column name, one directory per day. Rebalancing merges small days into few
        files and splits a day that holds most of the rows. Results are written aside first, so that the history
        and the newest results take the same rows."""
        rows = frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema.fields])
        if log is not RESULTS:
            self._append(log, rows)
            return
        batch, aside = self._announce(), CommitLog(self.spark, self._path(f"_aside_{log.name}"))
        folder = aside.write(rows)
        rows = aside.stored(folder, log.schema)
        self._append(log, rows)
        self._settle(batch, rows)
        aside.remove(folder)

    def _append(self, log: Log, rows: DataFrame) -> None:
        days = rows.withColumn(log.partition, F.to_date(log.moment)).hint("rebalance", log.partition)
        days.write.mode("append").partitionBy(log.partition).parquet(self._path(log.name))

    def cutoff(self, log: Log) -> datetime | None:
        """What the last pruning kept from."""
        value = self._log(log).current().kept.get("cutoff")
        return datetime.fromisoformat(value) if value else None

    def read(self, log: Log) -> DataFrame:
        """The whole log from its cutoff on, with its day column: filters on it prune directories."""
        schema = T.StructType([*log.schema.fields, T.StructField(log.partition, T.DateType())])
        if not self._days(log):
            return self.spark.createDataFrame([], schema)
        return self._since_cutoff(log, self.spark.read.schema(schema).parquet(self._path(log.name)))

    def _since_cutoff(self, log: Log, rows: DataFrame) -> DataFrame:
        cutoff = self.cutoff(log)
        if cutoff is None:
            return rows
        if log.partition in rows.columns:
            rows = rows.where(F.col(log.partition).isNull() | (F.col(log.partition) >= F.lit(cutoff.date())))
        return rows.where(F.col(log.moment).isNull() | (F.col(log.moment) >= F.expr(timestamp_literal(cutoff))))

    def newest_days(self, log: Log, days: int = 2) -> DataFrame:
        """The log's newest day and the ``days`` - 1 before it, as the day folders tell: no file of an
        older day is listed or opened."""
        dated = [n.partition("=")[2] for n in self._days(log) if n.partition("=")[2][:1].isdigit()]
        if not dated:
            return self.read(log)
        first = datetime.fromisoformat(dated[-1]).date() - timedelta(days=days - 1)
        return self.read(log).where(F.col(log.partition) >= F.lit(first))

    def prune(self, log: Log, as_of: datetime, days: int) -> None:
        """Drop rows older than ``days``: the cutoff is recorded by one commit, from which on readers skip them,
        also such that are appended later; then the folders of whole days before it are deleted. A step that
        fails leaves the log as it was or as it shall be, and can be repeated."""
        cutoff, commits = as_of - timedelta(days=days), self._log(log)

        def record(version: Version) -> bool:
            known = version.kept.get("cutoff")
            if known and known >= cutoff.isoformat():
                return True
            return commits.publish(version, snapshot=True, kept={"cutoff": cutoff.isoformat()})

        self._repeat(commits, record)
        fs, target = self._fs(self._path(log.name))
        for name in self._days(log):
            if name.partition("=")[2] < f"{self.cutoff(log):%Y-%m-%d}":
                fs.delete(self._fs(f"{self._path(log.name)}/{name}")[1], True)

    def apply_alert_retention(self, as_of: datetime) -> None:
        days = retention_days(self.rows(SETTINGS)).first()["days"]
        self.prune(ALERT_HISTORY, as_of, days)

    # -- the newest results of every rule

    def newest_results(self) -> DataFrame:
        """The two newest results of every rule: what latest and previous results need of the history, as a
        table that appends keep up to date. Where an append has not ended (yet), the history is read."""
        version = self._log(NEWEST_RESULTS).current()
        if version.kept.get("open"):
            return newest_two(self.read(RESULTS).drop(RESULTS.partition))
        return self._since_cutoff(RESULTS, self._newest_of(version))

    def _newest_of(self, version: Version, table: Keyed = NEWEST_RESULTS) -> DataFrame:
        """All rows of each key's newest commit."""
        by_key = Window.partitionBy(table.key).orderBy(F.col("__version").desc())
        rows = self._log(table).rows(version, table.schema, table.key)
        return rows.withColumn("__rank", F.rank().over(by_key)).where(F.col("__rank") == 1).drop("__rank", "__version")

    def _announce(self) -> str:
        """Note that an append begins; until it ends, the table of newest results may lack its rows."""
        log, batch = self._log(NEWEST_RESULTS), uuid.uuid4().hex
        self._repeat(log, lambda version: log.publish(version, kept={"open": [*version.kept.get("open", []), batch]}))
        return batch

    def _settle(self, batch: str, rows: DataFrame) -> None:
        """Merge an appended batch. If other appends are open, one of them may have died: all is computed anew."""
        log = self._log(NEWEST_RESULTS)

        def merge(version: Version) -> bool:
            if version.kept.get("open") != [batch]:
                self.rebuild_newest_results()
                return True
            known, rules = self._newest_of(version), rows.select(F.col("rule_id").alias("of")).distinct()
            touched = known.join(rules, F.col("rule_id").eqNullSafe(F.col("of")), "left_semi")
            folder = log.write(newest_two(touched.unionByName(rows)))
            if not log.publish(version, folder, kept={"open": []}):
                log.remove(folder)
                return False
            return True

        self._repeat(log, merge)
        self._compact_if_long(NEWEST_RESULTS)

    def rebuild_newest_results(self) -> None:
        """Compute the table from the whole history."""
        log = self._log(NEWEST_RESULTS)

        def rebuild(version: Version) -> bool:
            folder = log.write(newest_two(self.read(RESULTS).drop(RESULTS.partition)))
            if not log.publish(version, folder, snapshot=True, kept={"open": []}):
                log.remove(folder)
                return False
            return True

        self._repeat(log, rebuild)

    # -- counts per day

    def _day_digests(self) -> dict[str, str]:
        """What the results of each day are made of: the names and sizes of its files, and the cutoff within it."""
        cutoff, digests = self.cutoff(RESULTS), {}
        for name in self._days(RESULTS):
            day = name.partition("=")[2]
            fs, target = self._fs(f"{self._path(RESULTS.name)}/{name}")
            files = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(target) if not f.getPath().getName().startswith((".", "_")))
            if cutoff and day < f"{cutoff:%Y-%m-%d}":
                continue                                           # about to be dropped
            within = cutoff.isoformat() if cutoff and day == f"{cutoff:%Y-%m-%d}" else ""
            digests[day if day[:1].isdigit() else NO_DAY] = hashlib.sha256(json.dumps([files, within]).encode()).hexdigest()
        return digests

    def _stale_days(self, version: Version) -> tuple[DataFrame, dict[str, str]]:
        """The stored counts of days that are as they were, and the days that are not."""
        current, known = self._day_digests(), self._newest_of(version, DAILY_ROLLUP)
        stored = {r["day"]: r["digest"] for r in known.select("day", "digest").distinct().collect()}
        fresh = [day for day, digest in current.items() if stored.get(day) == digest]
        return known.where(F.col("day").isin(fresh)), {day: digest for day, digest in current.items() if day not in fresh}

    def _count_days(self, days: dict[str, str]) -> DataFrame:
        """Counts of some days, from their results alone."""
        dates = [datetime.fromisoformat(day).date() for day in days if day != NO_DAY]
        wanted = F.col(RESULTS.partition).isin(dates) if dates else F.lit(False)
        if NO_DAY in days:
            wanted = wanted | F.col(RESULTS.partition).isNull()
        day = F.coalesce(F.date_format("run_date", "yyyy-MM-dd"), F.lit(NO_DAY))
        digests = F.create_map(*[F.lit(v) for item in (days or {"": ""}).items() for v in item])
        return daily_rollup(self.read(RESULTS).where(wanted)).select(
            day.alias("day"), F.element_at(digests, day).alias("digest"), *ROLLUP_SCHEMA.names)

    def rollup(self) -> DataFrame:
        """Checks per day, table, dimension, severity and status, counting a rule's last result of a day. Days whose
        results changed since the last refresh (late or dropped ones) are counted from them."""
        fresh, stale = self._stale_days(self._log(DAILY_ROLLUP).current())
        rows = fresh.unionByName(self._count_days(stale)) if stale else fresh
        return rows.select(*ROLLUP_SCHEMA.names)

    def refresh_rollup(self) -> int:
        """Count the days that changed and store them; returns how many. All other days are left unread."""
        log, count = self._log(DAILY_ROLLUP), 0

        def refresh(version: Version) -> bool:
            nonlocal count
            _, stale = self._stale_days(version)
            count = len(stale)
            if not stale:
                return True
            folder = log.write(self._count_days(stale).coalesce(1))
            if not log.publish(version, folder):
                log.remove(folder)
                return False
            return True

        self._repeat(log, refresh)
        self._compact_if_long(DAILY_ROLLUP)
        return count

    # -- the newest rows of a log

    def newest(self, log: Log, n: int, where: Column | None = None) -> DataFrame:
        """The newest ``n`` rows for which ``where`` holds, ties in falling order of the first column. Day folders are walked
        backwards, twice as many at each step, until they hold enough."""
        days, take = [name for name in reversed(self._days(log)) if name.partition("=")[2][:1].isdigit()], 1
        while True:
            rows = self.read(log)
            if take < len(days):
                rows = rows.where(F.col(log.partition) >= F.lit(datetime.fromisoformat(days[take - 1].partition("=")[2]).date()))
            if where is not None:
                rows = rows.where(where)
            if take >= len(days) or rows.limit(n).count() >= n:
                return rows.orderBy(F.col(log.moment).desc(), F.col(log.schema.names[0]).desc()).limit(n)
            take *= 2

    # -- keyed tables

    def _rows_of(self, table: Keyed, version: Version) -> DataFrame:
        stored = T.StructType([*table.schema.fields, T.StructField("__deleted", T.BooleanType())])
        newest = Window.partitionBy(table.key).orderBy(F.col("__version").desc())
        current = self._log(table).rows(version, stored, table.key).withColumn("__rn", F.row_number().over(newest))
        return current.where((F.col("__rn") == 1) & ~F.col("__deleted")).select(*table.schema.names)

    def rows(self, table: Keyed) -> DataFrame:
        """The table as it is now. The frame keeps showing this version, whatever is written later."""
        return self._rows_of(table, self._log(table).current())

    def _shaped(self, table: Keyed, frame: DataFrame, deleted: bool) -> DataFrame:
        present = set(frame.columns)
        columns = [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
        return frame.select(*columns, F.lit(deleted).alias("__deleted"))

    def _commit(self, table: Keyed, frame: DataFrame, *, rows: int = 0, deleted: bool = False) -> int:
        """Add rows or markers as they are, whatever else was written meanwhile; returns the offset of new keys."""
        log, offset = self._log(table), 0
        folder = log.write(self._shaped(table, frame, deleted))

        def publish(version: Version) -> bool:
            nonlocal offset
            offset = version.last_id
            return log.publish(version, folder, rows=rows)

        self._repeat(log, publish)
        self._compact_if_long(table)
        return offset

    def insert(self, table: Keyed, rows: DataFrame | Iterable[dict], *, as_of: datetime, created_by: str | None = None) -> Sequence[int]:
        """Insert configuration rows with the next ids, in the order of the frame or list, and the table's
        defaults; returns the ids. Ids of deleted rows are not used again. A frame's rows stay on the executors:
        they are numbered by the counts of its partitions."""
        given = rows
        if not isinstance(rows, DataFrame):
            names = [n for n in table.schema.names if n != table.key]
            records = [tuple(row.get(n) for n in names) for row in rows]
            schema = T.StructType([f for f in table.schema.fields if f.name != table.key])
            given = self.spark.createDataFrame(records, schema).coalesce(1)
        defaults = {
            **(RULE_DEFAULTS if table is RULES else POLICY_DEFAULTS), "created_by": created_by, "created_at": as_of, "updated_at": as_of,
        }
        log = self._log(table)
        aside = log.write(given.select(*[c for c in given.columns if c in table.schema.names and c != table.key],
                                       F.monotonically_increasing_id().alias("__at")))
        placed = self.spark.read.parquet(f"{log.path}/{aside}")
        part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
        first, offsets = 1, []
        for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
            offsets.append((row["part"], first))
            first += row["count"]
        n = first - 1
        if not n:
            log.remove(aside)
            return []
        starts = F.broadcast(self.spark.createDataFrame(offsets, "__part long, __first long"))
        numbered = placed.withColumn("__part", part.cast("long")).join(starts, "__part").withColumn(table.key, F.col("__first") + within)
        for name, value in defaults.items():
            if name in table.schema.names and value is not None:
                literal = F.expr(timestamp_literal(value)) if isinstance(value, datetime) else F.lit(value)
                literal = literal.cast(table.schema[name].dataType)
                numbered = numbered.withColumn(name, F.coalesce(F.col(name), literal) if name in numbered.columns else literal)
        offset = self._commit(table, numbered, rows=n)
        log.remove(aside)
        ids = range(offset + 1, offset + 1 + n)
        return ids if isinstance(rows, DataFrame) else list(ids)

    def update(self, table: Keyed, edited: DataFrame, *, as_of: datetime, columns: Sequence[str]) -> int:
        """Write the rows whose ``columns`` changed, with a new ``updated_at``; returns how many. The edits
        are applied to the newest version; if another writer commits first, to the one it made."""
        log, edited, count = self._log(table), edited.select(table.key, *columns), 0

        def apply(version: Version) -> bool:
            nonlocal count
            current = self._rows_of(table, version)
            changed = changed_rows(current, edited, table.key, columns).select(table.key, *columns)
            changed = changed.withColumn("updated_at", F.expr(timestamp_literal(as_of)))
            merged = merge_rows(current, changed, [table.key]).join(changed.select(table.key), table.key, "left_semi")
            folder = log.write(self._shaped(table, merged, False))
            count = log.stored(folder, table.schema).count()
            if count and log.publish(version, folder):
                return True
            log.remove(folder)
            return not count

        self._repeat(log, apply)
        self._compact_if_long(table)
        return count

    def delete(self, table: Keyed, keys: DataFrame | Iterable) -> None:
        """Delete the rows with these keys: a list, or a frame with the key column."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(k,) for k in keys], T.StructType([table.schema[table.key]]))
        self._commit(table, keys.select(table.key).distinct(), deleted=True)

    def compact(self, table: Keyed) -> None:
        """Make one folder of a table's current rows, which replaces all others by a commit. The last two
        snapshots' commits and folders stay for readers; older ones are deleted."""
        log, number = self._log(table), 0

        def snapshot(version: Version) -> bool:
            nonlocal number
            number = version.number
            rows = self._newest_of(version, table) if table in (NEWEST_RESULTS, DAILY_ROLLUP) else self._shaped(table, self._rows_of(table, version), False)
            folder = log.write(rows.coalesce(1))
            if not log.publish(version, folder, snapshot=True):
                log.remove(folder)
                return False
            return True

        self._repeat(log, snapshot)
        log.clean(before=number + 1 - 2 * COMPACT_AFTER)

    def _compact_if_long(self, table: Keyed) -> None:
        if self._log(table).current().since_snapshot >= COMPACT_AFTER:
            self.compact(table)

    def set_settings(self, values: dict[str, str], *, as_of: datetime, insert_only: bool = False) -> None:
        log = self._log(SETTINGS)
        given = self.spark.createDataFrame([(k, v, as_of) for k, v in values.items()], SETTINGS_SCHEMA)

        def upsert(version: Version) -> bool:
            known = self._rows_of(SETTINGS, version).select("setting_key")
            folder = log.write(self._shaped(SETTINGS, given.join(known, "setting_key", "left_anti") if insert_only else given, False))
            if not log.publish(version, folder):
                log.remove(folder)
                return False
            return True

        self._repeat(log, upsert)
        self._compact_if_long(SETTINGS)

    def initialise(self, as_of: datetime) -> None:
        """Default settings, where they are not set yet."""
        self.set_settings(SETTING_DEFAULTS, as_of=as_of, insert_only=True)

    def setting(self, key: str) -> str | None:
        row = self.rows(SETTINGS).where(F.col("setting_key") == key).first()
        return row["setting_value"] if row else None
