"""Samples that read less: whole files are left out before the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.sources.files import listing

PLACES = 1_000_000


def file_place(seed: int) -> Column:
    """A file's place between 0 and 1, the same at every reading of it."""
    return F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.lit(seed)), F.lit(PLACES)) / F.lit(float(PLACES))


def sampled(frame: DataFrame, pct: float, seed: int = 42) -> tuple[DataFrame, float]:
    """About ``pct`` percent of a frame, and the percentage that it really stands for.

    Of a table of files, those whose place is below the fraction are scanned: Spark drops the others when it plans
    the scan, so they are not opened. One file is always kept; where the kept files hold more than the
    fraction, rows of them are sampled. A frame without files behind it is sampled by rows.
    """
    fraction = pct / 100
    if fraction >= 1:
        return frame, 100.0
    if not _plain_scan(frame):
        return frame.sample(fraction=fraction, seed=seed), float(pct)
    place = file_place(seed)
    files = listing(frame).select("length", place.alias("place"))
    total, least = files.agg(F.sum("length"), F.min("place")).first()
    if not total:
        return frame, 100.0
    limit = max(fraction, least + 0.5 / PLACES)
    kept = files.where(F.col("place") < limit).agg(F.sum("length")).first()[0] / total
    chosen, within = frame.where(place < limit), min(1.0, fraction / kept)
    if within < 1:
        chosen = chosen.sample(fraction=within, seed=seed)
    return chosen.select(*frame.columns), round(100 * kept * within, 4)


def _plain_scan(frame: DataFrame) -> bool:
    """Whether every row of the frame is a row of one file table: only then can files be left out."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in frame.columns and bool(frame.inputFiles())
