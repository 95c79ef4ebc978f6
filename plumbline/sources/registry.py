"""Monitored datasets by fully qualified name, and metadata about them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.text import quote_fqn
from plumbline.sources.files import footer_statistics, listing
from plumbline.sources.parallel import side_by_side

TABLES_SCHEMA = T.StructType([
    T.StructField("table_fqn", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("table_type", T.StringType()),
])
STATISTICS_SCHEMA = T.StructType([
    T.StructField("table_fqn", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("min_value", T.StringType()),
    T.StructField("max_value", T.StringType()),
])
COLUMNS_SCHEMA = T.StructType([
    T.StructField("table_fqn", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ordinal_position", T.IntegerType()),
])


class Registry:
    """Maps ``DB.SCHEMA.TABLE`` to a DataFrame, or to a function that opens one when it is first
    needed. Names that were not registered are looked up in the session catalog, so catalog tables
    and views need no registration."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[str, tuple[str, DataFrame | Callable[[], DataFrame], str]] = {}
        self._paths: dict[str, str] = {}

    def register(self, fqn: str, frame: DataFrame | Callable[[], DataFrame], table_type: str = "BASE TABLE",
                 path: str | None = None) -> "Registry":
        """``path``: the Parquet folder or file that the frame is all rows of, if there is one. Sizes and
        statistics then come from its listing and footers."""
        self._known[fqn.upper()] = (fqn, frame, table_type)
        self._paths.pop(fqn.upper(), None)
        if path:
            self._paths[fqn.upper()] = path
        return self

    def resolve(self, fqn: str) -> DataFrame:
        if fqn.upper() not in self._known:
            return self.spark.table(quote_fqn(fqn))
        name, frame, kind = self._known[fqn.upper()]
        if not isinstance(frame, DataFrame):
            frame = frame()
            self._known[fqn.upper()] = (name, frame, kind)
        return frame

    def sql(self, text: str) -> DataFrame:
        """Run SQL that names registered datasets, such as the check and sample SQL of a stored
        result. Each dataset the text mentions becomes a temporary view for it."""
        parts = re.split(r"('(?:[^'\\]|\\.)*')", text)          # literals are the odd parts
        views = []
        for fqn in self.names():
            mention = re.compile(re.escape(quote_fqn(fqn)), re.IGNORECASE)
            if any(mention.search(part) for part in parts[::2]):
                view = f"plumbline_view_{uuid.uuid4().hex}"
                self.resolve(fqn).createTempView(view)
                views.append(view)
                parts[::2] = [mention.sub(view, part) for part in parts[::2]]
        try:
            return self.spark.sql("".join(parts))                 # analysed now: the views are no longer needed
        finally:
            for view in views:
                self.spark.catalog.dropTempView(view)

    def register_schema(self, database: str, schema: str) -> "Registry":
        """Register every table and view of one catalog schema (table discovery)."""
        for table in self.spark.catalog.listTables(f"{database}.{schema}" if database else schema):
            if table.isTemporary:
                continue
            kind = "VIEW" if table.tableType == "VIEW" else "BASE TABLE"
            fqn = ".".join(p for p in (database, schema, table.name) if p)
            self.register(fqn, self.spark.table(quote_fqn(fqn)), kind)
        return self

    def open(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """The frames of several tables; those not opened yet are opened side by side."""
        chosen = self.names() if names is None else list(names)
        return dict(zip(chosen, side_by_side(self.spark, self.resolve, chosen)))

    def names(self) -> list[str]:
        return sorted(fqn for fqn, _, _ in self._known.values())

    def schemas(self) -> list[str]:
        return sorted({fqn.rpartition(".")[0] for fqn in self.names()})

    # -- metadata ---------------------------------------------------------------------------

    def tables(self) -> DataFrame:
        """One row per registered table; schema metadata only, no data is read."""
        rows = [(fqn, fqn.split(".")[-1], kind) for fqn, _, kind in self._known.values()]
        return self.spark.createDataFrame(sorted(rows), TABLES_SCHEMA)

    def columns(self) -> DataFrame:
        """One row per column of every registered table; schema metadata only."""
        rows = [
            (fqn, fqn.split(".")[-1], field.name, field.dataType.simpleString(), position)
            for fqn, frame in self.open().items()
            for position, field in enumerate(frame.schema.fields, start=1)
        ]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[4])), COLUMNS_SCHEMA)

    def row_counts(self, names: Iterable[str] | None = None) -> DataFrame:
        """``(table_fqn, table_name, row_count)`` as one plan: parquet answers from its footers."""
        frames = [
            frame.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(fqn).alias("table_fqn"), F.lit(fqn.split(".")[-1]).alias("table_name"), "row_count")
            for fqn, frame in self.open(names).items()
        ]
        return _union(frames)

    def sizes(self, names: Iterable[str] | None = None) -> DataFrame:
        """Bytes, files and last change per table out of one listing by tasks; no row is read. Tables that no
        files stand behind have neither."""
        frames, listed = self.open(names), []
        for fqn, frame in frames.items():
            path = self._paths.get(fqn.upper())
            if path or frame.inputFiles():
                listed.append(listing(frame, path).select(F.lit(fqn).alias("table_fqn"), "length", "modificationTime"))
        known = self.spark.createDataFrame([(fqn,) for fqn in frames], "table_fqn string")
        if not listed:
            return known.select("table_fqn", *(F.lit(None).cast(t).alias(c) for c, t in (("bytes", "long"), ("files", "long"), ("last_altered", "timestamp"))))
        sums = _union(listed).groupBy("table_fqn").agg(
            F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max("modificationTime").alias("last_altered"))
        return known.join(sums, "table_fqn", "left")

    def statistics(self, names: Iterable[str] | None = None) -> DataFrame:
        """Rows, nulls and bounds of every column of the tables registered with a path, from their files' footers, a
        few tables at a time. Bounds, as text, of integer, date and boolean columns; nulls of all but complex ones."""
        chosen = [n for n in (self.names() if names is None else names) if n.upper() in self._paths]
        frames = self.open(chosen)

        def of(fqn: str) -> list[tuple]:
            fields = frames[fqn].schema.fields
            found = footer_statistics(self.spark, self._paths[fqn.upper()], fields)
            rows = []
            for field in fields:
                filled, low, high = found["columns"][field.name]
                text = [None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in (low, high)]
                rows.append((fqn, fqn.split(".")[-1], field.name, found["rows"], None if filled is None else found["rows"] - filled, *text))
            return rows

        rows = [row for found in side_by_side(self.spark, of, chosen) for row in found]
        return self.spark.createDataFrame(rows, STATISTICS_SCHEMA)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
