"""A table as immutable folders, and numbered commit files that say which of them count.

A commit file is written aside and renamed to its number only if that number is still free, so of two
writers one gets it and the other starts again from the table as it is then. Until its commit
is there, a folder is not part of the table: a job that dies leaves nothing but an unused folder. The rename
must refuse an existing target, which HDFS does in one step; a local file system checks first.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ATTEMPTS = 1000
_LOCAL = threading.Lock()     # between the check and the rename of this process's own writers


@dataclass(frozen=True)
class Version:
    """A table as of one commit: its folders as (name, commit number, offset of its keys), the highest key
    given out, and further values that each commit carries on."""

    number: int = 0
    folders: tuple = ()
    last_id: int = 0
    kept: dict = field(default_factory=dict)
    since_snapshot: int = 0


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        target = self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return target.getFileSystem(self._conf), target

    def _numbers(self) -> list[int]:
        fs, folder = self._at("_commits")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _payload(self, number: int) -> dict:
        fs, file = self._at("_commits", f"{number:010d}")
        stream = fs.open(file)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> Version:
        """The newest version: the commits from the last snapshot on."""
        numbers, commits = self._numbers(), []
        for number in reversed(numbers):
            commits.append((number, self._payload(number)))
            if commits[-1][1]["snapshot"]:
                break
        if not commits:
            return Version()
        folders = tuple((c["folder"], number, c["offset"]) for number, c in reversed(commits) if c["folder"])
        newest = commits[0][1]
        return Version(commits[0][0], folders, newest["last_id"], newest["kept"], len(commits) - 1)

    def publish(self, after: Version, folder: str | None = None, *, rows: int = 0, snapshot: bool = False, kept: dict | None = None) -> bool:
        """Make ``folder`` part of the table as the commit next to ``after``; False if another writer was first.
        ``rows``: so many new keys, relative to the last one given out. A ``snapshot`` replaces all before it."""
        payload = {
            "folder": folder, "offset": after.last_id if rows else 0, "last_id": after.last_id + rows, "snapshot": snapshot,
            "kept": after.kept if kept is None else kept,
        }
        fs, aside = self._at("_commits", f"_{uuid.uuid4().hex}")
        stream = fs.create(aside)
        stream.write(json.dumps(payload).encode())
        stream.close()
        target = self._at("_commits", f"{after.number + 1:010d}")[1]
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            with _LOCAL:
                files.rename(aside, target, options)
            return True
        except Py4JJavaError as problem:
            fs.delete(aside, False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise

    def write(self, frame: DataFrame) -> str:
        """Store the rows in a new folder, which is not part of the table yet."""
        name = uuid.uuid4().hex
        frame.write.parquet(f"{self.path}/{name}")
        return name

    def remove(self, folder: str) -> None:
        fs, target = self._at(folder)
        fs.delete(target, True)

    def stored(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def rows(self, version: Version, schema: T.StructType, key: str) -> DataFrame:
        """The rows of all folders with ``__version``, the number of their commit; new keys are made absolute."""
        full = T.StructType([*schema.fields, T.StructField("__version", T.LongType())])
        if not version.folders:
            return self.spark.createDataFrame([], full)
        stored = self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name, _, _ in version.folders])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        known = F.create_map(*[F.lit(v) for name, number, _ in version.folders for v in (name, number)])
        columns = [F.col(n) for n in schema.names]
        if schema[key].dataType == T.LongType():
            offsets = F.create_map(*[F.lit(v) for name, _, offset in version.folders for v in (name, offset)])
            columns[schema.names.index(key)] = (F.col(key) + F.element_at(offsets, folder)).cast("long").alias(key)
        return stored.select(*columns, F.element_at(known, folder).cast("long").alias("__version"))

    def clean(self, before: int) -> None:
        """Delete the commits before a snapshot, and the folders that only they name."""
        version = self.current()
        used = {name for name, _, _ in version.folders}
        for number in [n for n in self._numbers() if n < before]:
            folder = self._payload(number)["folder"]
            if folder and folder not in used:
                self.remove(folder)
            fs, file = self._at("_commits", f"{number:010d}")
            fs.delete(file, False)
