"""Samples that leave out files, listings, footer statistics, and bounded sets of texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import _keep_smallest, profile_table, sampling_pct, sampling_rate, smallest_texts
from plumbline.sources.files import footer_statistics, footers, listing
from plumbline.sources.registry import Registry
from plumbline.sources.sampling import sampled
from tests.test_profile import NOW, by_column


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A table of 100 files, in a folder whose name needs escaping."""
    path = str(tmp_path_factory.mktemp("files") / "a table")
    spark.range(20_000).selectExpr("id", "concat('t', id % 1000) AS t", "date_add(date'2024-01-01', cast(id % 31 AS int)) AS d",
                                   "nullif(id % 7, 3) AS n", "id % 2 = 0 AS b", "array(id) AS a").repartition(100).write.parquet(path)
    return path


def scanned(frame):
    """(files, bytes) that the scan of a frame opened."""
    frame.select("id").collect()
    metrics = frame.select("id")
    metrics.collect()
    leaf = metrics._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("filesSize").value()


@pytest.mark.parametrize("pct", [5, 20, 60])
def test_a_sample_opens_a_part_of_the_files(spark, many, pct):
    frame = spark.read.parquet(many)
    files, size = scanned(frame)
    part, really = sampled(frame, pct, seed=3)
    opened, read = scanned(part)
    assert opened < files and abs(read / size - pct / 100) < 0.13 and part.columns == frame.columns
    assert abs(100 * part.count() / 20_000 - really) < 2
    again, same = sampled(spark.read.parquet(many), pct, seed=3)
    assert same == really and again.exceptAll(part).isEmpty()


def test_other_frames_are_sampled_by_rows(spark, many, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    part, really = sampled(one, 10)
    assert really == 10.0 and 380 < part.count() < 620                # one file is opened, its rows are sampled
    derived, really = sampled(spark.read.parquet(many).where("id < 10000"), 10)
    assert really == 10.0 and 800 < derived.count() < 1200
    assert sampled(one, 100)[0] is one
    one.where("false").write.parquet(str(tmp_path / "none"))
    assert sampled(spark.read.parquet(str(tmp_path / "none")), 10)[0].count() == 0


def test_profile_tells_what_it_sampled(spark, many):
    got = by_column(profile_table(spark.read.parquet(many), "t", as_of=NOW, sample_pct=20))
    assert abs(100 * got["id"].total_rows / 20_000 - got["id"].sampled_pct) < 2 and got["id"].sampled_pct <= 20
    assert by_column(profile_table(spark.read.parquet(many), "t", as_of=NOW))["id"].sampled_pct is None


def test_sampling_rate_of_a_column(spark):
    counts = [None, 0, 500_000, 500_001, 1_000_000, 10 ** 12]
    got = [r.p for r in spark.createDataFrame([(c,) for c in counts], "n long").select(sampling_rate(F.col("n")).alias("p")).collect()]
    assert got == [sampling_pct(c) for c in counts]


def test_listing_and_sizes(spark, many, tmp_path):
    import os

    files = [os.path.join(many, f) for f in os.listdir(many) if f.endswith(".parquet")]
    for rows in (listing(spark.read.parquet(many)), listing(spark.read.parquet(many), many)):
        found = rows.where("path like '%.parquet'").agg(F.count("*"), F.sum("length")).first()
        assert tuple(found) == (100, sum(map(os.path.getsize, files)))
        assert "content" not in rows.columns
    spark.range(10).selectExpr("id", "id % 3 AS k").write.partitionBy("k").parquet(str(tmp_path / "p"))
    known = Registry(spark).register("x.y.many", spark.read.parquet(many), path=many)
    known.register("x.y.parts", lambda: spark.read.parquet(str(tmp_path / "p"))).register("x.y.made", spark.range(3).toDF("n"))
    got = {r.table_fqn: (r.files, r.bytes) for r in known.sizes().collect()}
    assert got["x.y.made"] == (None, None) and got["x.y.many"][0] >= 100 and got["x.y.parts"][0] >= 3 and got["x.y.parts"][1] > 0


def test_statistics_come_from_footers(spark, many):
    known = Registry(spark).register("x.y.t", spark.read.parquet(many), path=many).register("x.y.made", spark.range(3).toDF("n"))
    got = {r.column_name: (r.row_count, r.null_count, r.min_value, r.max_value) for r in known.statistics().collect()}
    assert got == {"id": (20_000, 0, "0", "19999"), "t": (20_000, 0, None, None), "d": (20_000, 0, "2024-01-01", "2024-01-31"),
                   "n": (20_000, 2857, "0", "6"), "b": (20_000, 0, "false", "true"), "a": (20_000, None, None, None)}
    plan = footers(spark, many).agg(F.count("*"), F.min("id"), F.max("d"), F.count("t"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(d), COUNT(t)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"        # the caller's session is as it was


def test_footers_without_statistics(spark, tmp_path):
    path = str(tmp_path / "bare")
    spark.range(100).selectExpr("id", "cast(id AS string) AS s").write.option("parquet.column.statistics.enabled", "false").parquet(path)
    found = footer_statistics(spark, path, spark.read.parquet(path).schema.fields)
    assert found == {"rows": 100, "columns": {"id": (100, 0, 99), "s": (100, None, None)}}


def test_statistics_of_empty_tables(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.createDataFrame([], "i int, d date, s string").write.parquet(path)
    found = footer_statistics(spark, path, spark.read.parquet(path).schema.fields)
    assert found == {"rows": 0, "columns": {"i": (0, None, None), "d": (0, None, None), "s": (0, None, None)}}


def test_a_partition_keeps_a_bounded_set_of_texts(spark):
    """Texts that share a long beginning: 26 of each column leave a partition, whatever it held."""
    texts = [f"{'x' * 200}{k * 7919 % 1000:04d}" for k in range(1000)] + [None, "x"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 100], pa.string()), pa.array(["same"] * len(texts[i:i + 100]))], ["t", "u"])
               for i in range(0, len(texts), 100)]
    out = list(_keep_smallest(["t", "u"], 26)(iter(batches)))
    kept = {b.column(0)[0].as_py(): b.column(1).to_pylist() for b in out}
    assert kept == {"t": sorted(t for t in texts if t)[:26], "u": ["same"]}
    frame = spark.createDataFrame([(t, "same") for t in texts], "t string, u string").repartition(6)
    got = smallest_texts(frame, frame.schema.fields)
    assert got.count() <= 6 * 26 + 1 and {r.value for r in got.collect()} >= set(kept["t"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")                       # the sets are shuffled, not the texts


def test_texts_in_byte_order(spark):
    """Beyond ASCII, empty texts and null: the order is that of UTF-8 bytes, as Spark compares texts."""
    texts = ["é", "z", "", None, "\U0001F600", "￿", "a\x00", "a"]
    frame = spark.createDataFrame([(t,) for t in texts * 3], "t string")
    got = by_column(profile_table(frame, "t", as_of=NOW))["t"]
    assert got.values_list == [r.t for r in frame.where("t is not null").distinct().orderBy("t").collect()]
    assert got.distinct_count == 7 and got.null_count == 3
