"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over all labelled texts; every task sums its own count matrix, and the summed
matrix (languages x buckets) is the only thing that reaches the driver. Its log probabilities are
broadcast: (number of languages) x ``buckets`` x 4 bytes. Texts are scored sparsely: the distinct
buckets of a text and their counts, times the rows of the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, documents, id_text, merged_vectors, packed, remainder, share, unpacked, with_text_columns

ORDERS = (1, 2, 3)
PARTS = 8
UNDETERMINED = "und"


def letters_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def letter_codes(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-cased code points with every run of other characters as one 0, and a 0 at both ends.
    Empty if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table[np.minimum(codes, 0xFFFF)]
    astral = np.flatnonzero(codes > 0xFFFF)
    if len(astral):
        letter = letter.copy()
        letter[astral] = [chr(c).isalpha() for c in codes[astral].tolist()]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, codes, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]


def ngram_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Hashed buckets of all n-grams of a text, orders 1 to 3."""
    found, mixed = [], np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            break
        tail = codes[n - 1:]
        mixed = (mixed[:len(tail)] ^ tail) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        found.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray        # log share of training texts
    weights: np.ndarray      # buckets x languages, log probabilities, float32
    bits: int


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int = 15,
          smoothing: float = 0.5) -> LanguageModel:
    """Count the n-grams of every row with a non-null language. No row is sampled.

    Null texts and texts without letters count for a language's prior only. Without any labelled
    row the model has no languages and predicts ``und``.
    """
    def count(batches):
        table, sums, texts = letters_table(), {}, {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang], texts[lang] = np.zeros(1 << bits, np.int64), 0
                texts[lang] += 1
                sums[lang] += np.bincount(ngram_buckets(letter_codes(text or "", table), bits), minlength=1 << bits)
        if sums:
            rows = [(lang, part, piece) for lang, vector in sums.items()
                    for part, piece in enumerate([*np.split(vector, PARTS), np.array([texts[lang]])])]
            yield {"name": [r[0] for r in rows], "part": [r[1] for r in rows],
                   "counts": [r[2].astype(np.int64).tobytes() for r in rows]}

    labelled = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    partial = arrow_map(labelled.where("lang is not null"), count, "name string, part int, counts binary")
    vectors = {(r.name, r.part): np.frombuffer(bytes(r.counts), np.int64) for r in merged_vectors(partial).collect()}
    languages = sorted({name for name, _ in vectors})
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((1 << bits, 0), np.float32), bits)
    counts = np.stack([np.concatenate([vectors[lang, p] for p in range(PARTS)]) for lang in languages]) + smoothing
    texts = np.array([vectors[lang, PARTS][0] for lang in languages], float)
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return LanguageModel(languages, np.log(texts / texts.sum()), np.ascontiguousarray(weights), bits)


def predict(df: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``lang_score``, the posterior probability of the prediction.

    ``und`` with score 0 for null texts and texts without a letter. Equal posteriors: the language
    first in sorted order. Repeated rows are scored alike; an empty table stays empty.
    """
    shared = share(df.sparkSession, model)

    def make():
        model, table = shared.value, letters_table()

        def judged(text):
            codes = letter_codes(text or "", table)
            if not len(codes) or not model.languages:
                return UNDETERMINED, 0.0
            counts = np.bincount(ngram_buckets(codes, model.bits), minlength=1 << model.bits)
            present = np.flatnonzero(counts)
            logs = model.prior + counts[present].astype(np.float64) @ model.weights[present].astype(np.float64)
            best = int(logs.argmax())
            return model.languages[best], float(1 / np.exp(logs - logs[best]).sum())

        def columns(texts):
            found = [judged(text) for text in texts]
            return {"lang_pred": [f[0] for f in found], "lang_score": [f[1] for f in found]}

        return columns

    return with_text_columns(df, make, "lang_pred string, lang_score double", text_col)


def training_rows(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 5) != 0


def query(spark, sf_dir):
    """op4: learn from four folds, predict every document."""
    docs = documents(spark, sf_dir)
    return predict(id_text(docs), train(docs.where(training_rows()))).select(
        F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))


def filter_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is determined: all texts with a letter, however low the posterior.
    ``lang`` becomes the prediction; the columns stay as they were. Without any labelled row, all
    texts with a letter stay as they are."""
    model = train(docs.where(training_rows()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = predict(packed(docs), model)
    kept = judged.where(F.col("lang_pred") != UNDETERMINED)
    return unpacked(kept, docs, lang=F.col("lang_pred"))
