"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in Spark tasks.

A word's embedding joins ``DIM`` numbers from each of four hashed tables: of the whole word and of its first
4, 6 and 8 letters (zeros if it has no more letters than that), so that inflected and compound forms
share what they begin with. Filters of several widths slide over the words of the whole text; each
keeps its maximum, and a logistic layer scores the maxima. The first number of each table starts as the
shrunk log odds of its bucket among toxic texts; training then moves tables, filters and weights.

The threshold of each language is set on labelled rows that training did not see, a fifth of them. The language a
text is held to is judged from its words alone; a score of 0.5 stands for that language's threshold.

Every labelled text is used whole. Bucket counts are grouped by Spark. In each epoch the texts are dealt to
shards of about ``PIECE``; a shard starts from the shared model and runs over its texts, and the next shared model is
the mean over the shards: of a table's bucket, over those that met it. Sums are of whole numbers, so that
they don't depend on their order. What reaches the driver is bounded by the size of the model and the languages.
"""

from __future__ import annotations

import copy
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import (
    arrow_map, discard, documents, id_bitmap, id_text, release, remainder, share, slices, tight_files, with_text_columns, written,
)

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 6, 8)
TABLES = 1 + len(PREFIXES)
BITS = 18
DIM = 2
WIDTHS = (1, 2, 3)
FILTERS = 8
LANGUAGE_BITS = 12
PIECE = 4_000                            # texts of a shard
UNIT = 2.0 ** 28                         # of the whole numbers that stand for changes
ODDS_UNIT, ODDS_MOST = 256, 32           # steps of log odds that thresholds tell apart, and the largest of them


class Buckets(dict):
    """Hashed buckets of words, one for each table; 0 stands for nothing."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        parts = [word, *(word[:k] if len(word) > k else "" for k in PREFIXES)]
        size = (1 << BITS) - 1
        found = self[word] = tuple(zlib.crc32(f"{k}{p}".encode()) % size + 1 if p else 0 for k, p in enumerate(parts))
        return found

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros((0, TABLES), np.int32)
        return np.array([self[w] for w in words], np.int32)


@dataclass
class ToxicityModel:
    tables: np.ndarray                       # TABLES x buckets x DIM
    filters: list[np.ndarray]                # per width: width x inputs x FILTERS
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: list[str]
    words: np.ndarray                        # buckets x languages, log probabilities of words
    thresholds: np.ndarray                   # per language and, last, for any text: log odds

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[k, ids[:, k]] for k in range(TABLES)], axis=1)

    def maxima(self, x: np.ndarray, starts: np.ndarray):
        """Per text and filter the largest response and its place. ``x`` holds the texts one after the other,
        each followed by as many rows of zeros as the widest filter needs."""
        best, places = [], []
        for width, weights, offset in zip(WIDTHS, self.filters, self.offsets):
            n = len(x) - width + 1
            response = sum(x[j:j + n] @ weights[j] for j in range(width)) + offset
            ends = np.append(starts[1:], n)
            places.append(np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(starts, ends)]))
            best.append(np.take_along_axis(response, places[-1], axis=0))
        return best, places

    def log_odds(self, batch: list[np.ndarray]) -> np.ndarray:
        """Uncalibrated log odds of several texts."""
        x, starts = laid_out(self, batch)
        best, _ = self.maxima(x, starts)
        return np.maximum(np.concatenate(best, axis=1), 0) @ self.weights + self.bias

    def language(self, ids: np.ndarray) -> int:
        """Index of the language that a text's words speak for; the last threshold if there is none."""
        if not len(ids) or not self.languages:
            return len(self.languages)
        return int(self.words[ids[:, 0] & (1 << LANGUAGE_BITS) - 1].sum(axis=0).argmax())

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        shift = self.thresholds[[self.language(ids) for ids in batch]]
        return 1 / (1 + np.exp(np.clip(shift - self.log_odds(batch), -700, 700)))


def laid_out(model: ToxicityModel, batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = max(WIDTHS)
    sizes = np.array([len(ids) + gap for ids in batch])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = np.zeros((int(sizes.sum()) + gap, TABLES * DIM), np.float32)
    for ids, start in zip(batch, starts):
        if len(ids):
            x[start:start + len(ids)] = model.embedded(ids)
    return x, starts


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").distinct()


def with_folds(rows: DataFrame) -> DataFrame:
    """A fifth is held back."""
    return rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0)


def labelled_texts(docs: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lang, toxic, text, shard, held) of every labelled text, dealt by shard. Texts without a label are left out, by a
    bitmap of about 8 bits for each label and 16 MB at most, before any is shuffled. Labels are dealt like the texts, which
    meet them in their shard: a join on the id would shuffle the texts a second time once labels are too many for a broadcast."""
    known = known_labels(labels)
    shared = share(docs.sparkSession, id_bitmap(known.select("doc_id"), min(27, max(22, (8 * known.count()).bit_length()))))

    def task(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)), pa.bool_()))

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(task, texts.schema).unionByName(known, allowMissingColumns=True).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int")).repartition("shard")
    met = dealt.withColumn("known", F.collect_set("toxic").over(Window.partitionBy("shard", "doc_id"))).where("text is not null")
    return with_folds(met.select("doc_id", "lang", F.explode("known").alias("toxic"), "text", "shard"))


def with_buckets(texts: DataFrame) -> DataFrame:
    """The columns (doc_id, lang, toxic, text, shard, held) with ``ids``, the buckets of a text's words, in place of the text."""
    def task(batches):
        buckets = Buckets()
        for batch in slices(batches):
            yield {"doc_id": batch.column(0), "lang": batch.column(1), "toxic": batch.column(2),
                   "ids": [buckets.of(t).tobytes() for t in batch.column(3).to_pylist()], "shard": batch.column(4), "held": batch.column(5)}

    return arrow_map(texts.select("doc_id", "lang", "toxic", "text", "shard", "held"), task,
                     "doc_id long, lang string, toxic int, ids binary, shard int, held boolean")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, toxic, ids, held) of every labelled text; ``ids`` are its words' buckets."""
    return with_buckets(labelled_texts(docs, labels, 1)).drop("shard")


def read_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int32).reshape(-1, TABLES)


def train(docs: DataFrame, labels: DataFrame, *, epochs: int = 4, rate: float = 0.1, seed: int = 11) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, toxic). Null labels, texts and ids are passed
    over; a null language counts for none, and a text with both labels counts with each. Without labels of both
    classes every score is 0.5 or less: the model knows nothing."""
    rng = np.random.default_rng(seed)
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    count = {(r.held, r.toxic): r["count"] for r in with_folds(there.join(known_labels(labels), "doc_id")).groupBy("held", "toxic").count().collect()}
    clean, toxic = count.get((False, 0), 0), count.get((False, 1), 0)
    # texts are dealt, not the larger buckets; all that is stored of them is written once
    shards = max(-(-(clean + toxic) // PIECE), 1)
    with tight_files(docs.sparkSession):
        rows = written(with_buckets(labelled_texts(docs, labels, shards)).sortWithinPartitions(
            "held", "shard", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "toxic", "lang", "ids").drop("doc_id"), "labelled")
    dealt = rows.where("not held")
    release(docs.sparkSession)
    inputs = TABLES * DIM
    tables = rng.normal(0, 0.01, (TABLES, 1 << BITS, DIM)).astype(np.float32)
    tables[:, 0] = 0
    languages = sorted(r.lang for r in dealt.where("lang is not null").select("lang").distinct().collect())
    model = ToxicityModel(tables, [rng.normal(0, 0.1, (w, inputs, FILTERS)).astype(np.float32) for w in WIDTHS],
                          [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), 0.0,
                          languages, np.zeros((1 << LANGUAGE_BITS, len(languages)), np.float32), np.zeros(len(languages) + 1))
    if not clean or not toxic:
        model.bias, model.weights = -1.0, np.zeros_like(model.weights)
        discard(rows)
        return model
    start_tables(model.tables, dealt, toxic / (clean + toxic))
    for filters in model.filters:
        filters[0, ::DIM, :2] = 0.5                       # two filters begin by adding up the log odds
    model.bias = -float(np.log(clean / toxic)) - 1.0
    state = State(model)
    for epoch in range(epochs):
        averaged(state, dealt, epoch, toxic / (clean + toxic), rate, seed)
    model.words = language_words(dealt, languages)
    calibrate(model, rows.where("held"), {k: count.get((True, k), 0) for k in (0, 1)}, {
        r.toxic: r["count"] for r in labels.where("toxic in (0, 1)").groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()})
    discard(rows)
    return model


def start_tables(tables: np.ndarray, dealt: DataFrame, toxic: float, prior: float = 3.0) -> None:
    """Shrunk log odds of each bucket, counted once for each text, as the first number of its embedding."""
    def task(batches):
        counts = np.zeros((2, TABLES, 1 << BITS), np.int64)
        for batch in slices(batches):
            for label, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = read_ids(ids)
                for k in range(TABLES):
                    counts[label, k, np.unique(ids[:, k])] += 1
        k, bucket = np.nonzero(counts.any(axis=0))
        if len(k):
            yield {"k": k.astype(np.int32), "bucket": bucket.astype(np.int32), "n0": counts[0, k, bucket], "n1": counts[1, k, bucket]}

    partial = arrow_map(dealt.select("toxic", "ids"), task, "k int, bucket int, n0 long, n1 long")
    k, bucket, n0, n1 = columns(partial.groupBy("k", "bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    counts = np.zeros((2, TABLES, 1 << BITS))
    counts[0, k, bucket], counts[1, k, bucket] = n0, n1
    odds = np.log((counts[1] + prior * toxic) / (counts[0] + prior * (1 - toxic))) - np.log(toxic / (1 - toxic))
    tables[:, 1:, 0] = np.clip(odds, -1, 6)[:, 1:]


def columns(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(i).to_numpy() for i in range(table.num_columns)]


def language_words(dealt: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities of word buckets, from every fitted text that has a language."""
    def task(batches):
        counts = {}
        for batch in slices(batches):
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << LANGUAGE_BITS, np.int64)
                counts[lang] += np.bincount(read_ids(ids)[:, 0] & (1 << LANGUAGE_BITS) - 1, minlength=1 << LANGUAGE_BITS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield {"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": own[at]}

    partial = arrow_map(dealt.where("lang is not null").select("lang", "ids"), task, "lang string, bucket int, n long")
    lang, bucket, n = columns(partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    place = {name: i for i, name in enumerate(languages)}
    counts = np.full((1 << LANGUAGE_BITS, len(languages)), 0.5)
    counts[bucket.astype(np.int64), np.array([place[name] for name in lang], np.int64)] += n
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


class State:
    """A model in training: its parts and the sums of squared gradients (Adagrad) that belong to them."""

    def __init__(self, model: ToxicityModel):
        self.model, self.bias_speed = model, 0.1
        self.speed = [np.full(p.shape, 0.1, np.float32) for p in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.model.tables, *self.model.filters, *self.model.offsets, self.model.weights]

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Everything but the tables, and its sums, in a row."""
        flat = lambda parts, last: np.append(np.concatenate([p.ravel() for p in parts[1:]]).astype(np.float64), last)
        return flat(self.parts(), self.model.bias), flat(self.speed, self.bias_speed)

    def add(self, change: np.ndarray, speed: np.ndarray) -> None:
        at = 0
        for part, own in zip(self.parts()[1:], self.speed[1:]):
            part += change[at:at + part.size].reshape(part.shape).astype(np.float32)
            own += speed[at:at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
        self.model.bias += float(change[at])
        self.bias_speed += float(speed[at])


def averaged(state: State, dealt: DataFrame, epoch: int, toxic: float, rate: float, seed: int, held: int = 1024) -> None:
    """One epoch over all shards, each from ``state``; it becomes their mean."""
    shared = share(dealt.sparkSession, state)
    names = [*(f"d{i}" for i in range(DIM)), *(f"s{i}" for i in range(DIM))]

    def whole(values):
        return np.rint(np.asarray(values, np.float64) * UNIT).astype(np.int64)

    def task(batches):
        base, shard, rows, own, seen, words, rng = shared.value, None, [], None, 0, 0, None

        def run():
            order = rng.permutation(len(rows))
            descend(own, [rows[i][1] for i in order], np.array([rows[i][0] for i in order], np.float32), toxic, rate)
            rows.clear()

        def changes():
            moved = (own.speed[0] > base.speed[0]).any(axis=2)
            k, bucket = np.nonzero(moved)
            change, speed = (own.model.tables - base.model.tables)[k, bucket], (own.speed[0] - base.speed[0])[k, bucket]
            found = {"k": k.astype(np.int32), "bucket": bucket.astype(np.int32), "w": np.full(len(k), seen, np.int64)}
            for i in range(DIM):
                found[f"d{i}"], found[f"s{i}"] = whole(change[:, i]) * seen, whole(speed[:, i]) * seen
            yield found
            (after, after_speed), (before, before_speed) = own.dense(), base.dense()
            zeros, n = np.zeros(len(after), np.int64), len(after)
            found = {"k": np.full(n, -1, np.int32), "bucket": np.arange(n, dtype=np.int32), "w": np.full(n, seen, np.int64),
                     **dict.fromkeys(names, zeros)}
            found["d0"], found["s0"] = whole(after - before) * seen, whole(after_speed - before_speed) * seen
            yield found

        for batch in slices(batches):
            for number, label, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != shard or len(rows) >= held or words > 1_000_000:
                    if rows:
                        run()
                    words = 0
                if number != shard:
                    if own is not None:
                        yield from changes()
                    shard, own, seen, rng = number, copy.deepcopy(base), 0, np.random.default_rng([seed, epoch, number])
                ids = read_ids(ids)
                rows.append((label, ids))
                seen, words = seen + 1, words + len(ids)
        if own is not None:
            run()
            yield from changes()

    partial = arrow_map(dealt.select("shard", "toxic", "ids"), task, "k int, bucket int, w long, " + ", ".join(f"{n} long" for n in names))
    k, bucket, w, *sums = columns(partial.groupBy("k", "bucket").agg(F.sum("w").alias("w"), *(F.sum(n).alias(n) for n in names)))
    shared.unpersist()
    mean = np.stack(sums, axis=1) / (w * UNIT)[:, None]
    table = k >= 0
    state.model.tables[k[table], bucket[table]] += mean[table, :DIM].astype(np.float32)
    state.speed[0][k[table], bucket[table]] += mean[table, DIM:].astype(np.float32)
    dense = mean[~table][np.argsort(bucket[~table])]
    state.add(dense[:, 0], dense[:, DIM])


def descend(state: State, texts: list[np.ndarray], y: np.ndarray, toxic: float, rate: float, size: int = 32) -> None:
    """Adagrad over small batches; a filter's gradient goes to the window of its maximum."""
    model, parts, speed = state.model, state.parts(), state.speed
    n_widths = len(WIDTHS)

    def move(k, gradient, at=...):
        speed[k][at] += gradient ** 2
        parts[k][at] -= rate * gradient / np.sqrt(speed[k][at])

    balance = np.where(y > 0, 0.5 / toxic, 0.5 / (1 - toxic))
    for first in range(0, len(texts), size):
        batch = texts[first:first + size]
        x, starts = laid_out(model, batch)
        best, places = model.maxima(x, starts)
        pooled = np.concatenate(best, axis=1)
        active = np.maximum(pooled, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30)))
        error = ((p - y[first:first + size]) * balance[first:first + size] / len(batch)).astype(np.float32)
        back = error[:, None] * model.weights * (pooled > 0)
        gradient_x, touched = [], []
        for w, width in enumerate(WIDTHS):
            own = back[:, w * FILTERS:(w + 1) * FILTERS]
            gradient = np.zeros_like(model.filters[w])
            for j in range(width):
                at = places[w] + j
                gradient[j] = np.einsum("bf,bfi->if", own, x[at])
                gradient_x.append((own[:, :, None] * model.filters[w][j].T).reshape(-1, x.shape[1]))
                touched.append(at.ravel())
            move(1 + w, gradient)
            move(1 + n_widths + w, own.sum(axis=0))
        move(len(parts) - 1, active.T @ error)
        step = float(error.sum())
        state.bias_speed += step ** 2
        model.bias -= rate * step / state.bias_speed ** 0.5
        ids = np.zeros((len(x), TABLES), np.int32)
        for own, start in zip(batch, starts):
            ids[start:start + len(own)] = own
        touched, gradient_x = ids[np.concatenate(touched)], np.concatenate(gradient_x)
        for k in range(TABLES):
            buckets, places_of = np.unique(touched[:, k], return_inverse=True)
            total = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(total, places_of.ravel(), gradient_x[:, k * DIM:(k + 1) * DIM])
            total[buckets == 0] = 0
            speed[0][k, buckets] += total ** 2
            model.tables[k, buckets] -= rate * total / np.sqrt(speed[0][k, buckets])


def calibrate(model: ToxicityModel, held: DataFrame, held_of: dict[int, int], share_of: dict[int, int], least: int = 8) -> None:
    """The threshold with the fewest errors, in the labels' true proportions, for all texts and for each
    language with ``least`` toxic held-back texts. Every held-back text counts, by a small step of its log odds."""
    shared, most = share(held.sparkSession, model), ODDS_MOST * ODDS_UNIT

    def task(batches):
        model = shared.value
        for batch in slices(batches, 64):
            texts = [read_ids(ids) for ids in batch.column(1).to_pylist()]
            steps = np.clip(np.floor(model.log_odds(texts) * ODDS_UNIT), -most, most).astype(np.int32)
            yield {"toxic": batch.column(0), "spoken": [model.language(ids) for ids in texts], "step": steps}

    scored = arrow_map(held.select("toxic", "ids"), task, "toxic int, spoken int, step int")
    labels, spoken, steps, n = columns(scored.groupBy("toxic", "spoken", "step").agg(F.count("*").alias("n")))
    weight = n * np.array([share_of.get(k, 0) / max(held_of[k], 1) for k in (0, 1)])[labels]

    def threshold(at):
        z, places = np.unique(steps[at], return_inverse=True)
        below, above = (np.bincount(places, weight[at] * (labels[at] == k), len(z)) for k in (1, 0))
        # the cut before the i-th step: toxic texts below it and clean texts above it are errors
        errors = np.concatenate(([0], np.cumsum(below))) + np.concatenate((np.cumsum(above[::-1])[::-1], [0]))
        edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1] + 1) / 2, [z[-1] + 2])) / ODDS_UNIT
        good = np.flatnonzero(errors <= errors.min() + 1e-9)
        return edges[good[len(good) // 2]]

    if min(held_of.values()) > 0:
        model.thresholds[:] = threshold(np.arange(len(steps)))
    for k in range(len(model.languages)):
        at = np.flatnonzero(spoken == k)
        if n[at][labels[at] == 1].sum() >= least and n[at][labels[at] == 0].sum() >= least:
            model.thresholds[k] = threshold(at)


def scored(df: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``toxicity``, 0 to 1. Null and empty texts, and texts without letters, get the score of no
    evidence. Repeated rows are scored alike."""
    shared = share(df.sparkSession, model)

    def make():
        model, buckets = shared.value, Buckets()

        def columns(texts):
            out = []
            for first in range(0, len(texts), 64):
                out += model.scores([buckets.of(t or "") for t in texts[first:first + 64]]).tolist()
            return {"toxicity": out}

        return columns

    return with_text_columns(df, make, "toxicity double", text_col)


def query(spark, sf_dir):
    """op1: learn from labels of four folds, score every document."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = train(docs, labels)
    return scored(id_text(docs), model).select(
        F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
