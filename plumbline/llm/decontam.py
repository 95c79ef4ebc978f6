"""Benchmark decontamination: a broadcast hash set of normalised test windows, scanned over every text.

A word is a maximal run of digits, letters and non-ASCII characters after lower-casing A-Z. A window
is ``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. The benchmark reaches the workers in blocks of at most ``block_bytes`` of text, so what is
broadcast is bounded however large the benchmark is; one block is the usual case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents, packed, share, slices, unpacked, with_text_columns

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Windows:
    """All distinct windows of one block of benchmark items."""

    vocabulary: dict[bytes, int]             # word to 1, 2, ...
    multiplier: int
    tables: list[tuple[int, np.ndarray, np.ndarray, list[list[str]]]]  # width, sorted hashes, words, items


def hashed(words: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        total = total * np.uint64(multiplier) + words[i:i + len(total)].astype(np.uint64)
        total ^= total >> np.uint64(29)
    return total


def compile_windows(items: list[tuple[str, str | None]], width: int = 10) -> Windows:
    """The window tables of (item id, text) rows. Items without words have no window. A window that
    several items share names all of them."""
    vocabulary, owners = {}, {}
    for item, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall((text or "").encode().lower())]
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[i:i + size]), set()).add(item)
    multiplier = 0x9E3779B97F4A7C15
    while True:
        tables = []
        for size in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == size]
            words = np.array(windows, np.int64)
            codes = np.concatenate([hashed(row, size, multiplier) for row in words])
            order = np.argsort(codes)
            tables.append((size, codes[order], words[order], [sorted(owners[windows[i]]) for i in order]))
        if all(len(np.unique(t[1])) == len(t[1]) for t in tables):
            return Windows(vocabulary, multiplier, tables)
        multiplier += 2  # two windows share a hash: take another


def hits(words: np.ndarray, windows: Windows) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the items of these windows. A hash hit
    counts only if all its words are equal."""
    edges, found = np.zeros(len(words) + 1, np.int64), set()
    for size, codes, stored, owners in windows.tables:
        if len(words) < size:
            continue
        here = hashed(words, size, windows.multiplier)
        at = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
        for i in np.flatnonzero(codes[at] == here).tolist():
            if np.array_equal(words[i:i + size], stored[at[i]]):
                edges[i] += 1
                edges[i + size] -= 1
                found.update(owners[at[i]])
    return np.cumsum(edges[:-1]) > 0, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark's rows, at most ``block_bytes`` of text (or one item) at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append(("" if item is None else item, text))
        size += len(text)
    yield block


def contamination(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with ``n_words``, ``hit_words`` (positions of the hit words), ``hit_spans`` (start, end, start,
    end, ... in bytes of the UTF-8 text, first to last hit word of a run), ``items`` and ``clean_text``, the text without
    the spans.

    Null and empty texts have no words. An empty benchmark, or one without words, hits nothing. A
    null item id is the empty string; items that share an id count once.
    """
    spark, out, names = df.sparkSession, df, ("n_words", "hit_words", "hit_spans", "items", "clean_text")
    added = "n_words long, hit_words array<long>, hit_spans array<long>, items array<string>, clean_text string"
    for k, block in enumerate(blocks(benchmark, item_col, item_text_col, block_bytes)):
        shared = share(spark, compile_windows(block, width))

        def make(shared=shared):
            windows = shared.value
            vocabulary = windows.vocabulary

            def judged(text):
                data = (text or "").encode().lower()
                found = WORD.findall(data)
                words = np.fromiter(map(vocabulary.get, found, [0] * len(found)), np.int64, len(found))
                hit, items = hits(words, windows)
                positions, spans, last = np.flatnonzero(hit).tolist(), [], -2
                places = [m.span() for m in WORD.finditer(data)] if positions else []
                for p in positions:
                    if p - 1 == last:
                        spans[-1] = places[p][1]
                    else:
                        spans += places[p]
                    last = p
                return len(words), positions, spans, sorted(items), cut(text, spans) if spans else text

            def columns(texts):
                rows = [judged(text) for text in texts]
                return {name: [r[i] for r in rows] for i, name in enumerate(names)}

            return columns

        if not k:
            out = with_text_columns(out, make, added, text_col)
            continue
        # a further block of a large benchmark: hits add up, and the text is cut by the spans of all
        found = with_text_columns(out.withColumnsRenamed({c: f"{c}_before" for c in names}), make, added, text_col)
        out = found.withColumns({c: F.array_sort(F.array_union(c, f"{c}_before")) for c in ("hit_words", "items")}).withColumn(
            "hit_spans", F.concat("hit_spans_before", "hit_spans")).drop(*(f"{c}_before" for c in names))
        out = with_cut_text(out, text_col)
    return out


def with_cut_text(df: DataFrame, text_col: str) -> DataFrame:
    text_at, spans_at, clean_at = (df.columns.index(c) for c in (text_col, "hit_spans", "clean_text"))

    def task(batches):
        import pyarrow as pa

        for batch in slices(batches):
            pairs = zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist())
            yield batch.set_column(clean_at, "clean_text", pa.array([cut(t, s) if s else t for t, s in pairs], pa.string()))

    return df.mapInArrow(task, df.schema)


def query(spark, sf_dir):
    """op6: every document against every benchmark item."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the bytes of the spans, which may overlap."""
    data, kept, at = text.encode(), [], 0
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        kept.append(data[at:max(at, start)])
        at = max(at, end)
    return b"".join([*kept, data[at:]]).decode()


def remove_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the hit words of benchmark windows out of the texts; a document of which no word is left
    goes. ``n_chars`` follows the new text; texts without a hit stay as they are."""
    found = contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = found.where((F.size("hit_words") == 0) | (F.size("hit_words") < F.col("n_words")))
    clean = kept.withColumn("text", F.col("clean_text"))
    return unpacked(clean, docs, n_chars=F.when(F.size("hit_words") > 0, F.length("text")).otherwise(F.col("other.n_chars")))
