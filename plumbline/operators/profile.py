"""Column profiles: counts, bounds, distinct values, samples, signals.

Exact at every size, from three scans: one aggregate for counts and bounds; one deduplication of
``(column, key)`` pairs for the distinct counts and the smallest values, where texts and complex values
are keyed by a hash, so that whole documents are never shuffled; and, for tables with text columns, a
scan in which every partition keeps its 26 smallest distinct texts. All collapse hot values before their shuffle. A
caller who wants a sample asks for a fraction: it leaves out files before the scan, and ``sampled_pct`` tells
what was really read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.text import quote, string_literal, timestamp_literal
from plumbline.functions.time import boundary_difference_sql
from plumbline.sources.parallel import side_by_side
from plumbline.sources.sampling import sampled

# Limits of the profiler.
MAX_PROFILE_ROWS = 500_000
MAX_CATEGORICAL = 25
SAMPLE_VALUES = 5
HIGH_NULLS_PCT = 5

# Name fragments that mark a column as sensitive, and the metadata tags that do.
SENSITIVE_HINTS = (
    "EMAIL", "PHONE", "MOBILE", "SSN", "SOCIAL_SEC", "TAX_ID", "TIN", "NATIONAL_ID", "PASSPORT",
    "LICENSE", "DOB", "BIRTH", "ADDRESS", "STREET", "ZIP", "POSTAL", "FIRST_NAME", "LAST_NAME",
    "FULL_NAME", "CARD", "CC_NUM", "ACCOUNT_NUMBER", "ACCT_NUM", "ROUTING", "IBAN", "IP_ADDR",
    "PASSWORD", "SECRET", "TOKEN",
)
SENSITIVE_TAGS = ("SEMANTIC_CATEGORY", "PRIVACY_CATEGORY")
MASKING_TAG = "MASKING_POLICY"

# Columns per aggregate: four measures each stay under Spark's 100-field code generation limit, and
# a columnar scan reads every column once however many aggregates share the table.
COLUMNS_PER_PASS = 24


# The measured part of a profile.
FIGURES = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("table_name", T.StringType()), ("column_name", T.StringType()), ("data_type", T.StringType()),
        ("family", T.StringType()), ("ordinal_position", T.IntegerType()), ("sensitive", T.StringType()),
        ("total_rows", T.LongType()), ("null_count", T.LongType()), ("min_value", T.StringType()),
        ("max_value", T.StringType()), ("age_hours", T.DoubleType()), ("distinct_count", T.LongType()),
        ("smallest", T.ArrayType(T.StringType())), ("sampled_pct", T.DoubleType()))
])


def family(data_type: T.DataType) -> str:
    """numeric, temporal, text, complex or other (booleans belong to none of the four)."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType)):
        return "complex"
    return "other"


def sensitive_columns(schema: T.StructType, hints: Iterable[str] = SENSITIVE_HINTS) -> dict[str, str]:
    """Columns whose values must never be read, with the reason: a masking policy or a
    classification tag in the column metadata, or a name that suggests personal data."""
    reasons: dict[str, str] = {}
    for field in schema.fields:
        tags = {str(k).upper(): v for k, v in (field.metadata or {}).items()}
        tag = next((t for t in SENSITIVE_TAGS if t in tags), None)
        if tags.get(MASKING_TAG):
            reasons[field.name] = "masking policy"
        elif tag:
            reasons[field.name] = f"classified {tags[tag]}"
        elif any(hint in field.name.upper() for hint in hints):
            reasons[field.name] = "name suggests PII"
    return reasons


def sampling_pct(row_count: int, max_rows: int = MAX_PROFILE_ROWS) -> float | None:
    """Percentage that samples about ``max_rows`` rows, in tenths rounded up and at least 0.1; ``None``
    for tables that are not larger. Profiles never sample by themselves: pass it as ``sample_pct``."""
    if not row_count or row_count <= max_rows:
        return None
    return max(0.1, math.ceil(1000 * max_rows / row_count) / 10)


def sampling_rate(row_count: Column, max_rows: int = MAX_PROFILE_ROWS) -> Column:
    """The same percentage for a column of row counts."""
    tenths = F.ceil(F.lit(1000.0) * max_rows / row_count) / F.lit(10.0)
    return F.when(row_count > max_rows, F.greatest(F.lit(0.1), tenths))


def profile_table(
    frame: DataFrame,
    table: str,
    *,
    as_of: datetime,
    sample_pct: float | None = None,
    seed: int = 42,
    sensitive: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per column, over all rows unless ``sample_pct`` asks for a sample. Sensitive columns
    only get null and distinct counts."""
    return _finish(_figures(frame, table, as_of, sample_pct, seed, sensitive))


def profile_tables(frames: Mapping[str, DataFrame], *, as_of: datetime,
                   row_counts: Mapping[str, int] | None = None, sample_pct: Mapping[str, float] | None = None, seed: int = 42,
                   sensitive: Mapping[str, str] | None = None, failures: dict[str, str] | None = None) -> DataFrame:
    """Profiles of many tables; tables known to be empty are left out.

    Each table is profiled by a job of its own, a few tables at a time, and what comes back is one
    row per column. With ``failures`` given, a table that cannot be profiled is noted there and
    does not stop the others.
    """
    counts, samples = row_counts or {}, sample_pct or {}
    chosen = [(name, frame) for name, frame in frames.items() if counts.get(name, 1) > 0]

    def profile_of(item: tuple[str, DataFrame]):
        name, frame = item
        try:
            return _finish(_figures(frame, name, as_of, samples.get(name), seed, sensitive)).collect()
        except Exception as problem:  # noqa: BLE001 - reported per table
            if failures is None:
                raise
            failures[name] = str(problem)
            return []

    spark = chosen[0][1].sparkSession
    rows = [row for found in side_by_side(spark, profile_of, chosen) for row in found]
    return spark.createDataFrame(rows, _finish(spark.createDataFrame([], FIGURES)).schema)


def _figures(frame: DataFrame, table: str, as_of: datetime, sample_pct: float | None, seed: int,
             sensitive: Mapping[str, str] | None) -> DataFrame:
    """The measured part of a profile: counts, bounds, age, distinct count, smallest values."""
    guarded = dict(sensitive_columns(frame.schema) if sensitive is None else sensitive)
    source = frame
    if sample_pct is not None:
        source, sample_pct = sampled(frame, sample_pct, seed)
    positioned = list(enumerate(source.schema.fields, start=1))
    groups = [positioned[i:i + COLUMNS_PER_PASS] for i in range(0, len(positioned), COLUMNS_PER_PASS)]
    measured = _union([_measure(source, table, g, guarded, as_of) for g in groups])
    figures = measured.join(_distinct(source, guarded), "column_name", "left")
    return figures.withColumn("sampled_pct", F.lit(sample_pct).cast("double")).select(*FIGURES.names)


def _finish(figures: DataFrame) -> DataFrame:
    total = "greatest(total_rows, 1)"
    derived = figures.withColumn("values_list", F.when(_categorical(), F.col("smallest"))).selectExpr(
        "*",
        "coalesce(distinct_count, 0) AS n_distinct",
        f"round(100.0D * null_count / {total}, 2) AS null_pct",
        f"round(100.0D * coalesce(distinct_count, 0) / {total}, 2) AS uniqueness_pct",
        f"coalesce(array_join(slice(smallest, 1, {SAMPLE_VALUES}), ', '), '') AS sample_values",
    )
    return derived.select(
        "table_name", "column_name", "data_type", "family", "ordinal_position", "total_rows", "null_count",
        F.col("n_distinct").alias("distinct_count"), "min_value", "max_value", "age_hours", "sample_values", "sensitive",
        "null_pct", "uniqueness_pct", "values_list", signals().alias("signals"), "sampled_pct",
    )


def _measure(source: DataFrame, table: str, positioned: list[tuple[int, T.StructField]],
             guarded: Mapping[str, str], as_of: datetime) -> DataFrame:
    """Counts, bounds and age of a group of columns in one aggregate."""
    rows = []
    for position, field in positioned:
        column, kind = quote(field.name), family(field.dataType)
        readable = kind != "complex" and field.name not in guarded
        bound = "CAST({0}(" + column + ") AS STRING)" if readable else "CAST(NULL AS STRING)"
        age = "CAST(NULL AS DOUBLE)"
        if kind == "temporal" and readable:
            age = boundary_difference_sql("MINUTE", timestamp_literal(as_of), f"max({column})") + " / 60.0D"
        reason = string_literal(guarded[field.name]) if field.name in guarded else "CAST(NULL AS STRING)"
        rows.append(
            f"named_struct('table_name', {string_literal(table)}, 'column_name', {string_literal(field.name)}, "
            f"'data_type', {string_literal(field.dataType.simpleString())}, 'family', '{kind}', "
            f"'ordinal_position', {position}, 'sensitive', {reason}, 'total_rows', count(*), "
            f"'null_count', count_if({column} IS NULL), 'min_value', {bound.format('min')}, "
            f"'max_value', {bound.format('max')}, 'age_hours', {age})")
    return source.agg(F.expr(f"array({', '.join(rows)})").alias("m")).select(F.inline("m"))


def _distinct(source: DataFrame, guarded: Mapping[str, str]) -> DataFrame:
    """``(column_name, distinct_count, smallest)``: the up to 26 smallest distinct values as text, for
    readable columns; the others are only counted, from the same shuffled keys."""
    fields = source.schema.fields
    keys = distinct_keys(source, fields)
    counted = keys.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    hashed = [f.name for f in fields if family(f.dataType) in ("text", "complex")]
    texts = [f for f in fields if family(f.dataType) == "text" and f.name not in guarded]
    shown = keys.where(~F.col("column_name").isin([*hashed, *guarded])) if hashed or guarded else keys
    values = shown.select("column_name", F.col("key").cast("string").alias("value"))
    if texts:
        values = values.unionByName(smallest_texts(source, texts))
    return counted.join(smallest_values(values), "column_name", "left")


def distinct_keys(source: DataFrame, fields: Iterable[T.StructField]) -> DataFrame:
    """Distinct non-null ``(column_name, key)`` of all columns, from one scan and one shuffle. The key of a
    short value is its text, that of a text or complex value a 128-bit hash."""
    entries = [F.struct(F.lit(f.name).alias("column_name"), _key(f).alias("key")) for f in fields]
    return source.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("key").isNotNull()).distinct()


def _key(field: T.StructField) -> Column:
    column = F.col(quote(field.name))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = column + F.lit(0).cast(field.dataType)          # one zero, without a sign
    if family(field.dataType) == "text" or isinstance(field.dataType, T.BinaryType):
        return F.unhex(F.md5(column))
    if isinstance(field.dataType, T.MapType):
        column = F.array_sort(F.map_entries(column))
    if family(field.dataType) == "complex":
        return F.when(F.col(quote(field.name)).isNotNull(), F.unhex(F.md5(F.to_json(column))))
    return column.cast("string").cast("binary")


def smallest_texts(source: DataFrame, texts: list[T.StructField], keep: int = MAX_CATEGORICAL + 1) -> DataFrame:
    """``(column_name, value)``: the up to ``keep`` smallest distinct texts of each column. Every partition keeps a
    set of that many per column, batch by batch, and only these sets are shuffled and merged. Sets of
    bounded size are no SQL aggregate, so this works on Arrow batches; no row becomes a Python object."""
    names = [f.name for f in texts]
    columns = source.select(*[F.col(quote(n)).cast("string") for n in names])
    return columns.mapInArrow(_keep_smallest(names, keep), "column_name string, value string").distinct()


def _keep_smallest(names: list[str], keep: int):
    def kept(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        sets = {}
        for batch in batches:
            for k, column in enumerate(batch.columns):
                column = column.cast(pa.large_binary()).drop_null()
                if k in sets and len(sets[k]) == keep:
                    column = column.filter(pc.less(column, sets[k][-1]))
                values = pa.concat_arrays([column, sets[k]] if k in sets else [column]).unique()
                sets[k] = values.take(pc.sort_indices(values)[:keep])
        for k, values in sets.items():
            texts = values.cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(values), pa.string()), texts], ["column_name", "value"])

    return kept


def smallest_values(values: DataFrame, keep: int = MAX_CATEGORICAL + 1) -> DataFrame:
    """The first distinct values per column in text order; pruned before the shuffle to ``keep``
    per column and input partition."""
    in_order = Window.partitionBy("column_name").orderBy("value")
    first = values.withColumn("__rn", F.row_number().over(in_order)).where(F.col("__rn") <= keep)
    return first.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("smallest"))


def _categorical() -> Column:
    return (
        F.col("distinct_count").between(1, MAX_CATEGORICAL)
        & F.col("family").isin("text", "numeric")
        & F.col("sensitive").isNull()
    )


def signals() -> Column:
    """Short hints per column, in a fixed order."""
    key = "endswith(upper(column_name), '_ID')"
    return F.expr(f"""concat_ws(', ',
        'sensitive (' || sensitive || ')',
        CASE WHEN {key} AND uniqueness_pct >= 99 THEN 'PK?' WHEN {key} THEN 'FK?' END,
        CASE WHEN size(values_list) > 0 THEN 'categorical' END,
        CASE WHEN family = 'temporal' THEN 'timestamp' END,
        CASE WHEN null_pct > {HIGH_NULLS_PCT} THEN 'high nulls' END,
        CASE WHEN family = 'numeric' AND try_cast(min_value AS DOUBLE) < 0 THEN 'negatives' END)""")


def profile_kpis(profile: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    kpis = profile.agg(
        F.count_distinct("table_name").alias("tables_profiled"),
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("null_pct") > HIGH_NULLS_PCT).alias("high_null_columns"),
    )
    if suggestions is not None:
        kpis = kpis.withColumn("suggestions", suggestions.agg(F.count(F.lit(1))).scalar())
    return kpis


def with_rule_flag(profile: DataFrame, rules: DataFrame, database: str | None = None, schema: str | None = None) -> DataFrame:
    """Mark the columns an active rule of the same table names. Profiles carry short names, so the rules
    are restricted to the schema that was profiled."""
    for column, wanted in (("database_name", database), ("schema_name", schema)):
        if wanted is not None:
            rules = rules.where(F.upper(column) == wanted.upper())
    covered = rules.where(F.col("is_active") & F.col("column_name").isNotNull()).select(
        F.upper("table_name").alias("__t"), F.upper("column_name").alias("__c"), F.lit(True).alias("__covered"),
    ).distinct()
    same = (F.upper(profile["table_name"]) == F.col("__t")) & (F.upper(profile["column_name"]) == F.col("__c"))
    return profile.join(covered, same, "left").select(
        profile["*"], F.coalesce(F.col("__covered"), F.lit(False)).alias("has_rule"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
