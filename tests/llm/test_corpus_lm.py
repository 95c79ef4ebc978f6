"""LM scores of a corpus against exact counts, and word hashing against words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm, wordhash
from plumbline.llm.common import remainder
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"
END, START = object(), object()


def tokens(text):
    return [*(text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), END]


def counted(texts):
    words, pairs = Counter(), Counter()
    for text in texts:
        own = tokens(text)
        words.update(own)
        pairs.update(zip([START, *own], own))
    words[START] = len(texts)
    return words, pairs


def by_hand(text, words, pairs, share=0.2, read=lambda n: n):
    """(n_tokens, n_known, base, score); ``read`` is what the filter gives for a count."""
    total = sum(n for w, n in words.items() if w is not START)
    distinct = sum(w is not START for w, n in words.items() if n)
    own, base, score = tokens(text), 0.0, 0.0
    for before, word in zip([START, *own], own):
        c, b = read(words[word]), words[START] if before is START else read(words[before])
        joint = min(read(pairs[before, word]), b, c)
        base += math.log10((words[word] + 1) / (total + distinct + 1))
        score += math.log10(share * joint / max(b, 1) + (1 - share) * (c + 1) / (total + distinct + 1))
    return len(own), sum(words[w] > 0 for w in own), base, score


def quantised(n):
    return float(lm.estimates(lm.levels_of(np.array([n]), lm.level_bounds()))[0])


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + n, text) for n, text, *_ in frames.edge_rows()] + [(None, "no id at all"), rows[3], (10_004, "the same id")]
    return rows


@pytest.mark.parametrize("bits", [lm.BITS, 64])
def test_scores_against_exact_counts(spark, corpus, monkeypatch, bits):
    """Both routes; with the exchange also over several groups and shards. The expected score takes every count at
    its level; the filter reads a few n-grams too high, which moves a score by a hundredth at most on average."""
    monkeypatch.setattr(lm, "GROUPED", 3000)
    monkeypatch.setattr(lm, "PER_SHARD", 1000)
    frame = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("id", "train", "n")}).repartition(3)
    found, learned = lm.score_corpus(frame, remainder("doc_id", 7) != 2, bits=bits)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    held = {r.doc_id: r.h for r in frame.select("doc_id", (remainder("doc_id", 7) == 2).alias("h")).collect()}
    words, pairs = counted([text for n, text in corpus if not held[n]])
    assert learned == sum(n for w, n in words.items() if w is not START)
    expected = sorted(((n, *by_hand(text, words, pairs, read=quantised)) for n, text in corpus), key=str)
    assert len(got) == len(expected)
    off = []
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[3])), sorted(expected, key=lambda r: (str(r[0]), r[3]))):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6
        off.append(abs(a[4] - b[4]) / abs(b[4]))
    assert max(off) < 0.15 and sum(off) / len(off) < 0.01
    texts = {n: text for n, text in corpus[:200]}
    own = [r for r in got if r[0] in texts and held[r[0]]]
    assert sum(r[4] for r in own) > sum(r[3] for r in own)                       # better than the base on held-out texts


@pytest.mark.parametrize("bits", [lm.BITS, 0])
def test_scores_without_training(spark, bits):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found, learned = lm.score_corpus(frame, F.lit(False), bits=bits)
    assert learned == 0 and sorted((r.id, r.n_tokens, r.n_known, r.base_score) for r in found.collect()) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    assert lm.score_corpus(frames.empty_frame(spark), F.lit(True), bits=bits)[0].count() == 0


def test_planes_and_steps():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.from_steps(lm.steps(grams)) == grams).all() and len(lm.from_steps(lm.steps(grams[:0]))) == 0
    counts = np.arange(300, dtype=np.uint32)
    assert (lm.from_planes(lm.planes(counts), np.uint32) == counts).all()


def test_word_hashes(monkeypatch):
    """One hash for each word, whatever is around it; A-Z lowered; long words and texts over several pieces."""
    texts = [None, "", " \t\n\v\f\r ", "a", "A b\x00 a\x1c", "é É ü", "x" * 40_000, "X" * 40_000 + " y", *(frames.prose(k, 400) for k in range(20)), "tail"]
    for piece in (wordhash.PIECE, 50):
        monkeypatch.setattr(wordhash, "PIECE", piece)
        for column in (pa.array(texts, pa.string()), pa.array(["first", *texts], pa.string()).slice(1)):
            hashes, bounds = wordhash.words_of(column)
            seen = {}
            for k, text in enumerate(texts):
                words = (text or "").encode().lower().split()
                own = hashes[bounds[k]:bounds[k + 1]].tolist()
                assert len(own) == len(words)
                for word, value in zip(words, own):
                    assert seen.setdefault(word, value) == value
            assert len(set(seen.values())) == len(seen)
    assert [a.tolist() for a in wordhash.words_of(pa.array([], pa.string()))] == [[], [0]]
