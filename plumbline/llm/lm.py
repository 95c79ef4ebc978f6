"""LM scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training texts are aggregated by hash over the cluster. Their logarithms
are quantised, and an n-gram of level q is put into a Bloom filter q times, as (n-gram, 1) to (n-gram, q):
its count is read back by probing levels until one is missing. The filter's bits follow from the counted
entries; it is built in shards by the tasks that hold an n-gram. All words and pairs go in. Up to
``BITS`` it is broadcast; a larger one stays a table of shards: the distinct n-grams of a group of texts are
sent to their shards, and the levels found there are joined back to the group. Both ways read the same bits.

The probability of a word after another mixes that of the pair with the word's own:
share * c(u, w) / c(u) + (1 - share) * p(w), p(w) = (c(w) + 1) / (N + V + 1).

A whole corpus that is learned from and scored at once (``score_corpus``) needs neither of these detours: each
group of texts sends its distinct n-grams, with their counts, to their shards. The task of a shard adds the counts up,
builds its part of the filter, probes it for what the groups have sent, and the levels go back to the groups.

The base score needs every exact count. The most frequent words are broadcast with theirs (a fixed
number); all others are joined by their hash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    Hashes, arrow_map, discard, documents, id_text, release, remainder, share, slices, small_batches, text_bytes, written,
)
from plumbline.llm.wordhash import words_of

START, END = b"\x01 start", b"\x02 end"      # no word holds a space
TOP = 65_536
BITS = 1 << 27                                 # of a filter that is broadcast
SHARDS = 16                                    # at least
SHARD_BITS = 1 << 23                           # at most
PROBES = 4
BASE = 1.4
TOKENS = 2_000_000                             # counted together before they are shuffled
GROUP = 200                                    # texts scored together
ROUTED = 200_000                               # tokens of texts that ask a stored filter together
FILL = 8                                       # bits for each entry
GROUPED = 400_000                            # tokens of texts that are learned from and scored at once
PER_SHARD = 1_000_000                          # n-grams that groups send to one shard, about


def hashes_of(data: bytes, words: Hashes) -> np.ndarray:
    """Hashes of a text's tokens: words, then the end."""
    return words.of([*data.lower().split(), END])


def unigrams(tokens: np.ndarray) -> np.ndarray:
    return tokens & ~np.uint64(1)


def bigrams(tokens: np.ndarray, start: int) -> np.ndarray:
    """Hashes of (previous, token); the first token follows the start. The last bit tells pairs from words."""
    return pairs(np.concatenate((np.array([start], np.uint64), tokens[:-1])), tokens)


def pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (tokens >> np.uint64(1))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29)) | np.uint64(1)


def level_bounds() -> np.ndarray:
    """The least count of each level: 1, 2, 3, 4, and on by a factor of ``BASE``."""
    bounds = [1]
    while bounds[-1] < 1 << 62:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * BASE)))
    return np.array(bounds, np.int64)


def levels_of(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, counts, "right")


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts of the column ``text``: words and pairs."""
    def task(batches):
        words, held = Hashes(), 0
        start = words[START]
        for batch in batches:
            tokens = []
            for k, data in enumerate(texts := text_bytes(batch.column(0)), 1):
                tokens.append(hashes_of(data, words))
                held += len(tokens[-1])
                if held < TOKENS and k < len(texts):
                    continue
                held = 0
                for part in ([unigrams(t) for t in tokens], [bigrams(t, start) for t in tokens]):
                    grams, n = np.unique(np.concatenate(part), return_counts=True)
                    yield {"gram": grams.astype(np.int64), "n": n}
                tokens = []

    return arrow_map(docs.select("text"), task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    shards: np.ndarray       # shards x bytes, both powers of two

    def add(self, shard: int, grams: np.ndarray, level: np.ndarray) -> None:
        for at in self.places(grams, level):
            np.bitwise_or.at(self.shards[shard], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def places(self, grams: np.ndarray, level):
        """Bit positions within a shard, one array for each probe. A shard's bits are a power of two."""
        last = np.uint64(self.shards.shape[1] * 8 - 1)
        mixed = (grams ^ (np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        step = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20) | np.uint64(1)
        for k in range(PROBES):
            yield ((mixed + np.uint64(k) * step) & last).astype(np.int64)

    def has(self, grams: np.ndarray, level: int) -> np.ndarray:
        """Positions of the grams that seem to be there at a level; a miss ends a gram's probes."""
        found = np.arange(len(grams))
        for k in range(PROBES):
            here = grams[found]
            at = next(islice(self.places(here, np.uint64(level)), k, None))
            found = found[(self.shards[shard_of(here, len(self.shards)), at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return found

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The highest level reached by each gram; 0 if the first is missing."""
        level, active = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for q in range(1, len(level_bounds())):
            active = active[self.has(grams[active], q)]
            if not len(active):
                break
            level[active] = q
        return level

    def counts(self, grams: np.ndarray) -> np.ndarray:
        return estimates(self.levels(grams))


@dataclass
class StoredFilter:
    """A filter beyond the bound of a broadcast. Shards without an n-gram have no row."""
    table: DataFrame         # shard int, bits binary
    shards: int
    size: int                # bytes of a shard


def estimates(level: np.ndarray) -> np.ndarray:
    """Estimated counts: the middle of a level; 0 for none."""
    bounds = np.concatenate(([0.0], level_bounds().astype(float)))
    return np.where(level > 0, (bounds[level] + bounds[np.minimum(level + 1, len(bounds) - 1)] - 1) / 2, 0.0)


def shard_of(grams: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The first bits of a gram: sorted grams are sorted by shard. ``shards`` is a power of two."""
    return (grams >> np.uint64(1) >> np.uint64(64 - shards.bit_length())).astype(np.int64)


@dataclass
class LanguageModel:
    filter: Filter | StoredFilter | None
    tokens: int              # N
    distinct: int            # V
    texts: int
    top: dict[int, int]      # word hash to exact count
    share: float


def entries_of(counts: DataFrame) -> list:
    """Rows (from_n, entries): the filter's entries by count, the highest first."""
    bounds = F.array(*(F.lit(int(b)) for b in level_bounds()))
    level = F.size(F.filter(bounds, lambda bound: bound <= F.col("n")))
    # counts over a thousand are taken together, so that the driver gets a thousand rows at most
    entries = counts.groupBy("n").count().select(F.least("n", F.lit(1000)).alias("from_n"), (F.col("count") * level).alias("entries"))
    return entries.groupBy("from_n").agg(F.sum("entries").alias("entries")).orderBy(F.desc("from_n")).collect()


def shape_of(entries: int) -> tuple[int, int]:
    """(shards, bytes of each) of a filter: at least ``FILL`` bits for each entry, at most twice as many."""
    bits = max(SHARDS * 64, 1 << (entries * FILL - 1).bit_length())
    shards = max(SHARDS, bits // SHARD_BITS)
    return shards, bits // 8 // shards


def least_count(counts: DataFrame, bits: int) -> int:
    """The smallest count from which on all n-grams fit into a filter of so many bits. For information: the
    model leaves none out."""
    total, least = 0, 1001
    for row in entries_of(counts):
        total += row.entries
        if total > bits // FILL:
            return least
        least = row.from_n
    return 1


def train(docs: DataFrame, *, bits: int = BITS, top: int = TOP, share_of_pairs: float = 0.2) -> tuple[LanguageModel, DataFrame]:
    """The model of the texts (column ``text``), and their exact word counts (gram, n).

    Null and empty texts count as one end token. Without any text there are no counts: every token
    has probability 1 / (0 + 0 + 1). ``bits`` bounds what is broadcast, not what the model holds.
    """
    counts = written(count_ngrams(docs), "counts")
    release(docs.sparkSession)
    words = counts.where("gram & 1 = 0")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    shards, size = shape_of(sum(row.entries for row in entries_of(counts)))

    def build(batches):
        """A row for each shard: all of a shard's n-grams are in one task."""
        own, bounds = {}, level_bounds()
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            level = levels_of(batch.column(1).to_numpy(zero_copy_only=False), bounds)
            of = shard_of(grams, shards)
            order = np.argsort(of, kind="stable")
            each, first = np.unique(of[order], return_index=True)
            for shard, at in zip(each.tolist(), np.split(order, first[1:])):
                table = own.setdefault(shard, Filter(np.zeros((1, size), np.uint8)))
                for q in range(1, level[at].max() + 1):
                    at = at[level[at] >= q]
                    table.add(0, grams[at], q)
        for shard, table in own.items():
            yield {"shard": [shard], "bits": [table.shards[0].tobytes()]}

    dealt = counts.repartition(shards, F.shiftrightunsigned("gram", 65 - shards.bit_length()))
    built = arrow_map(dealt, build, "shard int, bits binary")
    if shards * size * 8 > bits:
        stored = StoredFilter(written(built, "shards"), shards, size)
        words = written(words, "words")
        discard(counts)
    else:
        stored = Filter(np.zeros((shards, size), np.uint8))
        for row in built.toLocalIterator():
            stored.shards[row.shard] = np.frombuffer(bytes(row.bits), np.uint8)
    frequent = words.orderBy(F.desc("n"), "gram").limit(top).collect()
    end = xxhash.xxh3_64_intdigest(END) & ~1
    exact = {row.gram & (1 << 64) - 1: row.n for row in frequent}
    ends = words.where(F.col("gram") == int(np.uint64(end).astype(np.int64))).select("n").first()
    exact[end] = ends.n if ends else 0
    model = LanguageModel(stored, totals.tokens, totals.distinct, exact[end], exact, share_of_pairs)
    return model, words


SCORED = "id long, key long, gram long, times long, n_tokens long, known long, base double, score double"


def scored(model: LanguageModel, ids: list, keys: np.ndarray, n: np.ndarray, grams: np.ndarray, places: np.ndarray,
           c: np.ndarray, joint: np.ndarray) -> dict:
    """A row for each text, with what is known here, and one for each of its words without a broadcast
    count. The gram of a text's own row is odd and thus no word's.

    ``n`` has the tokens of each text; ``grams`` their distinct words, ``places`` and the counts ``c`` and
    ``joint`` are those of each token."""
    total = model.tokens + model.distinct + 1.0
    top = np.array(sorted(model.top), np.uint64)
    top_counts = np.array([model.top[g] for g in top.tolist()], np.int64)
    of, edges = np.repeat(np.arange(len(n)), n), np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.minimum(np.searchsorted(top, grams), len(top) - 1)
    exact = np.where(top[at] == grams, top_counts[at], -1)[places]
    seen = exact >= 0
    base = np.bincount(of[seen], np.log10((exact[seen] + 1) / total), len(n))
    known = np.bincount(of[exact > 0], minlength=len(n))
    before = np.concatenate(([0.0], c[:-1]))
    before[edges] = model.texts
    joint = np.minimum(joint, np.minimum(before, c))     # a pair is no more frequent than its words
    p = model.share * joint / np.maximum(before, 1) + (1 - model.share) * (c + 1) / total
    score = np.bincount(of, np.log10(p), len(n))
    rare, times = np.unique(of[~seen] * len(grams) + places[~seen], return_counts=True)
    text = rare // len(grams)
    none, zero = [None] * len(rare), np.zeros(len(n), np.int64)
    return {
        "id": [*ids, *(ids[i] for i in text.tolist())], "key": np.concatenate((keys, keys[text])),
        "gram": np.concatenate((keys | 1, grams[rare % len(grams)].astype(np.int64))), "times": np.concatenate((zero, times)),
        "n_tokens": [*n.tolist(), *none], "known": [*known.tolist(), *none], "base": [*base.tolist(), *none],
        "score": [*score.tolist(), *none]}


def by_broadcast(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = share(docs.sparkSession, model)

    def task(batches):
        words, model = Hashes(), shared.value
        start = words[START]
        for batch in slices(batches, GROUP):
            texts = text_bytes(batch.column(1))
            tokens = [hashes_of(data, words) for data in texts]
            grams, places = np.unique(unigrams(np.concatenate(tokens)), return_inverse=True)
            places = places.ravel()
            yield scored(
                model, batch.column(0).to_pylist(), np.array([key_of(data) for data in texts], np.int64),
                np.array([len(t) for t in tokens]), grams, places, model.filter.counts(grams)[places],
                model.filter.counts(np.concatenate([bigrams(t, start) for t in tokens])))

    return arrow_map(docs, task, SCORED)


def by_shards(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The same rows with a stored filter. Groups of texts are written as hashes, so that a group keeps its
    number when a task runs again, and texts are split into words once."""
    stored, spark = model.filter, docs.sparkSession
    table, shards, size = stored.table, stored.shards, stored.size
    shared = share(spark, replace(model, filter=None))

    def kind(n):
        return np.uint16 if n <= 1 << 16 else np.uint32

    def grouped(batches):
        words, number = Hashes(), TaskContext.get().partitionId() << 32
        ids, keys, tokens, held = [], [], [], 0

        def row():
            hashes, places = np.unique(np.concatenate(tokens), return_inverse=True)
            return {"part": [number], "ids": [ids], "keys": [keys], "n": [[len(t) for t in tokens]],
                    "hashes": [hashes.astype(np.int64)], "places": [places.ravel().astype(kind(len(hashes))).tobytes()]}

        for batch in slices(batches):
            for id, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ids.append(id)
                keys.append(key_of(data))
                tokens.append(hashes_of(data, words))
                held += len(tokens[-1])
                if held >= ROUTED:
                    yield row()
                    ids, keys, tokens, held, number = [], [], [], 0, number + 1
        if ids:
            yield row()

    def unpacked(n, hashes, places):
        """(n, words, pairs) of each token of a group."""
        n, hashes = (c.values.to_numpy(zero_copy_only=False) for c in (n, hashes))
        tokens = hashes.astype(np.int64).view(np.uint64)[np.frombuffer(places.as_py(), kind(len(hashes)))]
        before = np.concatenate((tokens[:1], tokens[:-1]))
        before[np.concatenate(([0], np.cumsum(n)[:-1]))] = xxhash.xxh3_64_intdigest(START)
        return n, unigrams(tokens), pairs(before, tokens)

    def asked(batches):
        for batch in batches:
            for part, *group in zip(*batch.columns):
                grams = np.unique(np.concatenate(unpacked(*group)[1:]))
                shard, first = np.unique(shard_of(grams, shards), return_index=True)
                yield {"shard": shard, "part": [part.as_py()] * len(shard), "grams": np.split(grams.astype(np.int64), first[1:])}

    def answered(batches):
        """Rows come sorted by shard, the shard's bits first."""
        current, own = None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                run = batch.slice(at[0], len(at))
                if shard[at[0]] != current:
                    current, bits = shard[at[0]], run.column(3)[0].as_py()
                    own = Filter(np.frombuffer(bits or bytes(size), np.uint8).reshape(1, size))
                levels = own.levels(run.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(run.column(2)), 0).to_numpy(zero_copy_only=False))
                found = [a.astype(np.uint8).tobytes() for a in np.split(levels, ends[:-1])]
                rows = [(p, f) for p, f in zip(run.column(1).to_pylist(), found) if p is not None]
                yield {"part": [p for p, _ in rows], "shard": [current] * len(rows), "levels": [f for _, f in rows]}

    def task(batches):
        model = shared.value
        for batch in batches:
            for ids, keys, *group, levels in zip(*batch.columns):
                n, words, joint = unpacked(*group)
                grams, at = np.unique(np.concatenate((words, joint)), return_inverse=True)
                found = estimates(np.frombuffer(b"".join(levels.as_py()), np.uint8).astype(np.int64))[at.ravel()]
                unique, places = np.unique(words, return_inverse=True)
                yield scored(model, ids.as_py(), keys.values.to_numpy(zero_copy_only=False), n, unique, places.ravel(),
                             found[:len(words)], found[len(words):])

    groups = written(arrow_map(
        docs, grouped, "part long, ids array<long>, keys array<long>, n array<long>, hashes array<long>, places binary"), "groups")
    asking = arrow_map(groups.select("part", "n", "hashes", "places"), asked, "shard int, part long, grams array<long>")
    null = F.lit(None)
    both = asking.withColumn("bits", null.cast("binary")).unionByName(
        table.select("shard", null.cast("long").alias("part"), null.cast("array<bigint>").alias("grams"), "bits"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("part").asc_nulls_first())
    answers = written(arrow_map(dealt, answered, "part long, shard int, levels binary"), "levels")
    release(spark)
    levels = answers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "levels"))).alias("found"))
    joined = groups.join(levels, "part").select("ids", "keys", "n", "hashes", "places", F.col("found.levels").alias("levels"))
    return arrow_map(joined, task, SCORED)


def score(df: DataFrame, model: LanguageModel, words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), one row per row of ``df``. Null texts are empty: they have
    the end token alone. Repeated rows are scored alike; ids may repeat or be null."""
    docs = id_text(df, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    total = model.tokens + model.distinct + 1.0
    rows = by_shards(docs, model) if isinstance(model.filter, StoredFilter) else by_broadcast(docs, model)
    joined = rows.join(words.select("gram", F.col("n").alias("c")), "gram", "left")
    c, copies = F.coalesce("c", F.lit(0)), F.count("n_tokens")
    found = joined.groupBy("id", "key").agg(
        copies.alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"),
        (F.max("known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0)) / copies).cast("long").alias("n_known"),
        (F.max("base") + F.sum(F.col("times") * F.log10((c + 1) / F.lit(total))) / copies).alias("base_score"))
    each = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))      # equal rows were scored as one
    return found.select("id", "n_tokens", "n_known", "base_score", "score", each.alias("each")).drop("each")


# -- a whole corpus at once -----------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all first bytes first: high bytes of small numbers are zeros in a row, which the
    shuffle compresses away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(grams: np.ndarray) -> bytes:
    """Sorted n-grams as their differences."""
    return planes(np.diff(grams, prepend=np.uint64(0)))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def corpus_groups(df: DataFrame, training, id_col: str, text_col: str) -> DataFrame:
    """Groups of texts as hashes: (part, ids, train, n, hashes, places, grams), ``n`` the tokens of each text,
    ``places`` those of the tokens in ``hashes``, ``grams`` how many different n-grams there are at most."""
    end = np.uint64(xxhash.xxh3_64_intdigest(END))
    docs = id_text(df, id_col, text_col, F.coalesce(training, F.lit(False)).cast("int").alias("train")).withColumn("id", F.col("id").cast("long"))

    def grouped(batches):
        number = TaskContext.get().partitionId() << 32
        ids, train, n, tokens, held = [], [], [], [], 0

        def row():
            words = unigrams(np.concatenate(tokens))
            hashes, places = np.unique(words, return_inverse=True)
            return {"part": [number], "ids": [ids], "train": [train], "n": [n], "hashes": [hashes.astype(np.int64)],
                    "places": [planes(places.ravel().astype(np.uint32))], "grams": [len(hashes) + len(words)]}

        for batch in slices(batches):
            words, bounds = words_of(batch.column(1))
            sizes, first = np.diff(bounds), 0
            for k, size in enumerate(sizes.tolist()):
                held += size + 1
                if held >= GROUPED or k == len(sizes) - 1:
                    tokens.append(np.insert(words[bounds[first]:bounds[k + 1]], bounds[first + 1:k + 2] - bounds[first], end))
                    n += (sizes[first:k + 1] + 1).tolist()
                    ids += batch.column(0)[first:k + 1].to_pylist()
                    train += batch.column(2)[first:k + 1].to_pylist()
                    first = k + 1
                if held >= GROUPED:
                    yield row()
                    ids, train, n, tokens, held, number = [], [], [], [], 0, number + 1
        if ids:
            yield row()

    return arrow_map(docs, grouped, "part long, ids array<long>, train array<long>, n array<long>, hashes array<long>, places binary, grams long")


def corpus_tokens(n, hashes, places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, hashes, places, pairs) of a group's tokens."""
    n, hashes = (c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (n, hashes))
    hashes, places = hashes.view(np.uint64), from_planes(places.as_py(), np.uint32)
    tokens = hashes[places]
    before = np.concatenate((tokens[:1], tokens[:-1]))
    before[np.concatenate(([0], np.cumsum(n)[:-1]))] = xxhash.xxh3_64_intdigest(START)
    return n, hashes, places, pairs(before, tokens)


def by_exchange(groups: DataFrame, grams: int, share_of_pairs: float) -> tuple[DataFrame, int]:
    """(id, n_tokens, n_known, base_score, score) of all texts of the groups, and the tokens learned from."""
    shards = max(SHARDS, 1 << (grams // PER_SHARD).bit_length())

    def sent(batches):
        for batch in slices(batches, 1):
            part, train = batch.column(0)[0].as_py(), batch.column(1)[0].values.to_numpy(zero_copy_only=False)
            n, hashes, places, joint = corpus_tokens(*(batch.column(k)[0] for k in (2, 3, 4)))
            learned = np.repeat(train > 0, n)
            joint, at = np.unique(joint, return_inverse=True)
            own = np.concatenate((hashes, joint))
            times = np.concatenate((np.bincount(places[learned], minlength=len(hashes)), np.bincount(at.ravel()[learned], minlength=len(joint))))
            order = np.argsort(own, kind="stable")
            own, times = own[order], times[order].astype(np.uint32)
            shard, first = np.unique(shard_of(own, shards), return_index=True)
            yield {"shard": shard, "part": [part] * len(shard), "grams": [steps(g) for g in np.split(own, first[1:])],
                   "times": [planes(t) for t in np.split(times, first[1:])]}

    def answered(batches):
        current, parts, own, times = None, [], [], []
        for batch in slices(batches, 64):
            for shard, part, grams, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if shard != current:
                    if parts:
                        yield from replies(current, parts, own, times)
                    current, parts, own, times = shard, [], [], []
                parts.append(part), own.append(from_steps(grams)), times.append(from_planes(n, np.uint32))
        if parts:
            yield from replies(current, parts, own, times)

    def replies(shard, parts, own, times):
        """Counts of a shard's n-grams over all groups, its filter, and the levels read back by probing it."""
        grams, at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(at.ravel(), np.concatenate(times), len(grams)).astype(np.int64)       # below 2 ** 53: exact
        level = levels_of(total, level_bounds())
        bits = max(64, 1 << max(int(level.sum()) * FILL - 1, 0).bit_length())
        table, active = Filter(np.zeros((1, bits // 8), np.uint8)), np.flatnonzero(level)
        for q in range(1, int(level.max(initial=0)) + 1):
            active = active[level[active] >= q]
            table.add(0, grams[active], q)
        found, word = table.levels(grams).astype(np.uint8), grams & np.uint64(1) == 0
        ends = np.cumsum([len(g) for g in own])[:-1]
        counts = [total[a][word[a]] for a in np.split(at.ravel(), ends)]
        yield {"part": parts, "shard": [shard] * len(parts), "levels": [found[a].tobytes() for a in np.split(at.ravel(), ends)],
               "counts": [planes(c) for c in counts], "distinct": [0] * len(parts)}
        yield {"part": [-1], "shard": [shard], "levels": [b""], "counts": [b""], "distinct": [int((total[word] > 0).sum())]}

    asked = arrow_map(groups.select("part", "train", "n", "hashes", "places"), sent, "shard long, part long, grams binary, times binary")
    dealt = asked.repartition("shard").sortWithinPartitions("shard", "part")
    with small_batches(groups.sparkSession, 200):
        answers = written(arrow_map(dealt, answered, "part long, shard long, levels binary, counts binary, distinct long"), "levels")
    del asked, dealt                                   # nothing refers to what was sent: its files can go
    for _ in range(2):                                 # the first collection drops the plans, the second their shuffles
        release(groups.sparkSession)
        time.sleep(1)
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    tokens, texts = groups.select(F.explode(F.arrays_zip("train", "n")).alias("t")).where("t.train > 0").agg(
        F.coalesce(F.sum("t.n"), F.lit(0)), F.count("*")).first()

    def task(batches):
        total = tokens + distinct + 1.0
        for batch in slices(batches, 1):
            n, hashes, places, joint = corpus_tokens(*(batch.column(k)[0] for k in (1, 2, 3)))
            unique, at = np.unique(joint, return_inverse=True)
            order = np.argsort(np.concatenate((hashes, unique)), kind="stable")
            level = np.empty(len(order), np.int64)
            level[order] = np.frombuffer(b"".join(batch.column(4)[0].as_py()), np.uint8)
            exact = np.concatenate([from_planes(c, np.int64) for c in batch.column(5)[0].as_py()])[places]     # words are sorted by shard
            c, joint = estimates(level[:len(hashes)])[places], estimates(level[len(hashes):])[at.ravel()]
            of, edges = np.repeat(np.arange(len(n)), n), np.concatenate(([0], np.cumsum(n)[:-1]))
            before = np.concatenate(([0.0], c[:-1]))
            before[edges] = texts
            joint = np.minimum(joint, np.minimum(before, c))     # a pair is no more frequent than its words
            p = share_of_pairs * joint / np.maximum(before, 1) + (1 - share_of_pairs) * (c + 1) / total
            yield {"id": batch.column(0)[0].as_py(), "n_tokens": n, "n_known": np.bincount(of[exact > 0], minlength=len(n)),
                   "base_score": np.bincount(of, np.log10((exact + 1) / total), len(n)), "score": np.bincount(of, np.log10(p), len(n))}

    levels = answers.where("part >= 0").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "levels", "counts"))).alias("found"))
    joined = groups.join(levels, "part").select("ids", "n", "hashes", "places", F.col("found.levels").alias("levels"), F.col("found.counts").alias("counts"))
    return arrow_map(joined, task, "id long, n_tokens long, n_known long, base_score double, score double"), tokens


def score_corpus(df: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, top: int = TOP,
                 share_of_pairs: float = 0.2) -> tuple[DataFrame, int]:
    """(id, n_tokens, n_known, base_score, score), one row per row of ``df``, and the tokens learned from: the rows
    for which ``training`` holds (null: not). Null texts are empty. Every row is scored by its own text; ids may
    repeat or be null. Without training rows every token has probability 1 / (0 + 0 + 1), times one less the pairs' share.

    A filter of up to ``bits`` is broadcast; beyond that, n-grams and levels are exchanged with its shards."""
    groups = written(corpus_groups(df, training, id_col, text_col), "groups")
    grams = groups.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    if grams * FILL > bits:
        return by_exchange(groups, grams, share_of_pairs)
    discard(groups)
    model, words = train(df.where(training), bits=bits, top=top, share_of_pairs=share_of_pairs)
    return score(df, model, words, id_col=id_col, text_col=text_col), model.tokens


def key_of(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def query(spark, sf_dir):
    """op5: learn from six folds of seven, score every document."""
    docs = documents(spark, sf_dir)
    found, tokens = score_corpus(docs, remainder("doc_id", 7) != 2)
    return found.select(
        F.col("id").alias("doc_id"), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
