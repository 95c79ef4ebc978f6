"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate that rejects a text. On a bounded sample every rule is timed and its
rejections are counted; the cascade then tests the rules by rejections per second, highest first, and a
row that one rule rejects is not tested by the next (``CASE`` evaluates no further). The order
changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` maps the prefix of the measured columns to a predicate."""

    name: str
    rejects: Column


def measured(df: DataFrame, *, text_col: str = "text", width: int = 5, prefix: str = "") -> DataFrame:
    """``df`` with ``words`` (array), ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` and ``n_dup_lines`` (lines
    with a word), and ``n_repeat_words``: words inside a window of ``width`` words that occurs twice or more.

    A null text has no words and zeros. Windows are compared by a 64-bit hash of their words. Existing
    columns with one of these names are replaced; ``prefix`` avoids that.
    """
    def name(column):
        return f"{prefix}{column}"

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    df = df.withColumns({
        name("words"): words,
        name("lines"): lines,
        name("word_chars"): F.length(F.translate(text, SPACE, "")).cast("long"),
        name("n_symbols"): (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    n = F.size(name("words"))
    hashes = F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(F.col(name("words")), i, width)))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        name("n_words"): n.cast("long"),
        name("n_lines"): F.size(name("lines")).cast("long"),
        name("n_dup_lines"): (F.size(name("lines")) - F.size(F.array_distinct(name("lines")))).cast("long"),
        name("windows"): hashes,
    }).drop(name("lines"))
    repeated = F.size(F.array_distinct(name("windows"))) < F.size(name("windows"))
    df = df.withColumn(name("windows"), F.when(repeated, F.array_sort(F.transform(
        F.col(name("windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    windows = F.col(name("windows"))
    pairs = F.filter(F.arrays_zip(windows.alias("a"), F.slice(windows, 2, F.greatest(F.size(windows) - 1, F.lit(1))).alias("b")),
                     lambda p: p["a"]["h"] == p["b"]["h"])
    df = df.withColumn(name("windows"), F.when(windows.isNotNull(), pairs))
    starts = F.array_sort(F.array_distinct(F.concat(
        F.transform(name("windows"), lambda p: p["a"]["i"]), F.transform(name("windows"), lambda p: p["b"]["i"]))))
    df = df.withColumn(name("windows"), F.when(F.col(name("windows")).isNotNull(), starts))
    windows = F.col(name("windows"))
    steps = F.zip_with(windows, F.slice(windows, 2, F.greatest(F.size(windows), F.lit(1))),
                       lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
    covered = F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    return df.withColumn(name("n_repeat_words"), F.coalesce(covered, F.lit(0)).cast("long")).drop(name("windows"))


def default_rules(text_col: str = "text", prefix: str = "") -> list[QualityRule]:
    """Rules on top of the measured columns; each leaves ordinary prose alone. A null text passes them."""
    def col(name):
        return F.col(f"{prefix}{name}")

    text, words = F.coalesce(F.col(text_col).cast("string"), F.lit("")), col("words")
    letterless = F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}")))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    marks = F.length(text) - F.length(F.translate(text, "!?", ""))
    bullets = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^\s*[-*•]\s")))
    return [
        QualityRule("symbols", col("n_symbols") * 10 > col("word_chars")),
        QualityRule("repeated lines", col("n_dup_lines") * 10 > col("n_lines") * 3),
        QualityRule("word length", (col("word_chars") < col("n_words") * 2) | (col("word_chars") > col("n_words") * 20)),
        QualityRule("without letters", letterless * 10 > col("n_words") * 4),
        QualityRule("capitals", upper * 10 > col("word_chars") * 6),
        QualityRule("exclamations", marks * 2 > col("n_words")),
        QualityRule("bullets", bullets * 10 > col("n_lines") * 9),
    ]


def ordered(df: DataFrame, rules: list[QualityRule], *, sample_rows: int = 1000, rows: int | None = None,
            prepare=lambda sample: sample) -> list[QualityRule]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows, highest first. Rules that
    reject nothing come last, cheapest first. ``rows`` spares the count if the caller knows it; ``prepare`` adds
    the columns that the rules need to the sample alone."""
    if len(rules) < 2:
        return list(rules)
    rows = df.count() if rows is None else rows
    sample = prepare(df.sample(min(1.0, sample_rows / max(rows, 1)), seed=7)).cache()
    try:
        def timed(predicate):
            started = time.perf_counter()
            hits = sample.agg(F.coalesce(F.sum(F.when(predicate, 1)), F.lit(0))).first()[0]
            return time.perf_counter() - started, hits

        timed(F.lit(True))
        idle = min(timed(F.lit(True))[0] for _ in range(2))
        found = {}
        for rule in rules:
            (first, hits), (second, _) = timed(rule.rejects), timed(rule.rejects)
            found[rule.name] = hits, max(min(first, second) - idle, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: (-found[r.name][0] / found[r.name][1], found[r.name][1], r.name))


def rejected(rules: list[QualityRule]) -> Column:
    """Whether any rule rejects, tested in the given order and no further than needed. An unknown
    (null) predicate does not reject."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(True)).otherwise(verdict)
    return verdict


def base_failed(prefix: str = "") -> Column:
    """Fewer than 10 words, or over a fifth of the words inside repeated windows."""
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (repeated * 100 > n * 20)


def query(spark, sf_dir):
    """op7: measures and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    table = measured(docs)
    rules = ordered(docs, default_rules(), rows=docs.count(), prepare=measured)
    return table.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.when(F.col("base_failed"), F.lit(True)).otherwise(rejected(rules))).alias("kept"))
