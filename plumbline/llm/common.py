"""What the text operators share: input columns, Arrow mapping, merged count vectors, word hashing."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """The two columns an operator reads, and further expressions; all other columns of the
    caller's table are left alone, whatever their names."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def remainder(id_col: str, modulus: int):
    """crc32 of the id's text modulo ``modulus``: the fold of a row. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``function(batches)`` yields dicts of columns in the order of ``schema``."""

    def task(batches):
        arrow_schema = None
        for columns in function(batches):
            if arrow_schema is None:
                arrow_schema = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in schema.split(", "))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(task, schema)


def slices(batches, rows: int = 512):
    """The same rows in small batches: what a task holds as Python objects stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def with_text_columns(df: DataFrame, make, added: str, text_col: str = "text") -> DataFrame:
    """``df`` with columns computed from its texts, in place: no shuffle, no join.

    ``make()`` runs once per task and returns a function from a list of texts (None for null) to a
    dict of the ``added`` columns. Columns of ``df`` that bear one of these names are replaced.
    """
    names = [c.split()[0] for c in added.split(", ")]
    df = df.drop(*names)
    at = df.columns.index(text_col)

    def task(batches):
        function, kinds = make(), [(n, _ARROW[t]) for n, t in (c.split() for c in added.split(", "))]
        for batch in slices(batches):
            columns = function(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(columns[n], kind) for n, kind in kinds)],
                names=[*batch.schema.names, *names])

    return df.mapInArrow(task, StructType([*df.schema.fields, *_parse_datatype_string(added).fields]))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as (text, other): the remaining columns in one struct, so that no name can clash."""
    return docs.select(F.col("text").cast("string").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("other"))


def unpacked(df: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """The columns of ``docs`` out of what ``packed`` made; ``replaced`` gives new expressions for some
    that ``docs`` has."""
    def column(field):
        if field.name in replaced:
            return replaced[field.name].cast(field.dataType).alias(field.name)
        return (F.col("text") if field.name == "text" else F.col("other")[field.name]).alias(field.name)

    return df.select(*map(column, docs.schema.fields))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def merged_vectors(df: DataFrame, salts: int = 16) -> DataFrame:
    """Sum rows (name string, part int, counts binary of int64) to one row per name and part.

    Two rounds: rows of a key are first dealt over ``salts`` tasks, so that no task receives the
    partial vectors of all others. Each task streams and keeps one running sum per key.
    """
    def total(batches):
        sums = {}
        for batch in batches:
            for name, part, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                vector = np.frombuffer(counts, np.int64)
                key = name, part
                if key in sums:
                    sums[key] += vector
                else:
                    sums[key] = vector.copy()
        if sums:
            yield {"name": [k[0] for k in sums], "part": [k[1] for k in sums],
                   "counts": [v.tobytes() for v in sums.values()]}

    schema = "name string, part int, counts binary"
    salted = df.withColumn("salt", F.spark_partition_id() % salts).repartition("name", "part", "salt")
    first = arrow_map(salted.select("name", "part", "counts"), total, schema)
    return arrow_map(first.repartition("name", "part"), total, schema)


class _ByValue:
    """Unpickles to ``value``, whose classes travel with it: executors need not have this package."""

    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.value),)


def share(spark: SparkSession, value):
    """``value`` as a broadcast variable for tasks. A Python worker keeps it for its later tasks."""
    return spark.sparkContext.broadcast(_ByValue(value))


class Hashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    mixed = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        mixed = (mixed ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``. A session without
    that setting must be local; its own temporary folder is used then."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.sparkContext._temp_dir
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: later steps, and tasks that are
    run again after an executor is lost, start from the files."""
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for what runs within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs run within pass this many rows at most to a Python worker at once: for rows that hold whole sets."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tight_files(spark: SparkSession):
    """What is stored within takes less disk: repeated numbers leave zstd at about three fifths of their size in snappy."""
    return setting(spark, "spark.sql.parquet.compression.codec", "zstd")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the driver's objects for
    them are collected, which on an idle driver may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed to the system: for a Python worker that has dropped large tables and goes on
    with other tasks."""
    gc.unfreeze()
    gc.collect()                                  # also empties the free lists, whose objects keep whole arenas
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # the C library of Linux has it
    if trim:
        trim(0)


class Bitmap:
    """A fixed-size set of hashed ids that may contain more than was put in."""

    def __init__(self, bits: int = 22):
        self.bits, self.cells = bits, np.zeros(1 << (bits - 3), np.uint8)

    def places(self, ids: np.ndarray) -> np.ndarray:
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)

    def add(self, ids: np.ndarray) -> None:
        at = self.places(ids)
        np.bitwise_or.at(self.cells, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids)
        return (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def id_bitmap(ids: DataFrame, bits: int = 22) -> Bitmap:
    """The first column's values as a bitmap of fixed size (512 KB). With very many ids it lets every row
    pass, which costs time only."""
    def task(batches):
        own = Bitmap(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield {"name": ["bits"], "part": [0], "counts": [own.cells.tobytes()]}

    def united(batches):
        total = None
        for batch in batches:
            for cells in batch.column(2).to_pylist():
                cells = np.frombuffer(cells, np.uint8)
                total = cells.copy() if total is None else total | cells
        if total is not None:
            yield {"name": ["bits"], "part": [0], "counts": [total.tobytes()]}

    schema = "name string, part int, counts binary"
    partial = arrow_map(ids, task, schema)
    merged = arrow_map(arrow_map(partial.repartition(16), united, schema).coalesce(1), united, schema)
    out = Bitmap(bits)
    for row in merged.collect():
        out.cells |= np.frombuffer(bytes(row.counts), np.uint8)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = df.inputFiles()
    if path:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path[0].rpartition("/")[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release(spark)
