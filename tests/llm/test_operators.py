"""The text operators on edge rows, against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from plumbline.llm import (
    automata, bpe, decontam, jaccard, language, lm, quality, repeats, secrets, suffixarray, tokencount, toxicity,
)
from plumbline.llm.common import merged_vectors
from plumbline.llm.components import connected
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


# --- building blocks

def test_suffix_array():
    pick = random.Random(5)
    for _ in range(500):
        text = [pick.randrange(1, pick.choice((2, 3, 11))) for _ in range(pick.randrange(40))]
        order = suffixarray.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixarray.common_prefixes(text, order)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:], text[order[k]:]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_automaton_is_minimal_and_equivalent():
    import re

    patterns = ["(?i:ab|ac)+d?", "[0-9]{2,3}", "x\\x20*[:=]y*"]
    table, accepted = automata.compiled(patterns)
    pick = random.Random(2)
    for _ in range(3000):
        data = "".join(pick.choice("aAbcdDx :=y019") for _ in range(pick.randrange(7)))
        state = 1
        for byte in data.encode():
            state = table[state, byte]
        expected = sum(1 << k for k, p in enumerate(patterns) if re.fullmatch(p, data))
        assert accepted[state] == expected
    keys = {(int(accepted[s]), *table[s].tolist()) for s in range(len(table))}
    assert len(keys) == len(table)
    with pytest.raises(ValueError):
        automata.parsed("a|)")


def test_connected(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)]
    edges += [(200 + i, 201 + i) for i in range(25)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lone_suffixes_and_bounded_prefixes():
    """Strings of mostly different numbers, as pieces of contexts are, and prefixes compared no farther than asked."""
    pick = random.Random(7)
    for n in (1, 2, 3, 50, 400):
        for many in (2, 5, 3 * n):
            text = [pick.randrange(many) + 1 for _ in range(n)]
            order = suffixarray.suffix_array(text)
            assert order == sorted(range(n), key=lambda i: text[i:])
            whole = suffixarray.common_prefixes(text, order).tolist()
            for k in range(1, n):
                a, b = text[order[k - 1]:], text[order[k]:]
                assert whole[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert suffixarray.common_prefixes(text, order, 2).tolist() == [min(v, 2) for v in whole]


def test_merged_vectors(spark):
    rows = [("a", k % 2, np.full(4, k, np.int64).tobytes()) for k in range(10)]
    got = merged_vectors(spark.createDataFrame(rows, "name string, part int, counts binary").repartition(4), salts=3)
    assert {r.part: np.frombuffer(bytes(r.counts), np.int64).tolist() for r in got.collect()} == {0: [20] * 4, 1: [25] * 4}


# --- 1 toxicity

def test_toxicity_learns_and_scores_edges(spark):
    pick = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        words = [f"{pick.choice('bcdfg')}{pick.choice('aeiou')}w{pick.randrange(200)}".translate(str.maketrans("0123456789", "abcdefghij"))
                 for _ in range(pick.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(pick.randrange(len(words)), pick.choice(("rotten", "vilething", "vilestuff")))
        docs.append((i, " ".join(words), "en" if i % 2 else None, "s", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(i + 1000, *r[1:]) for i, r in enumerate(frames.edge_rows())]
    frame, known = spark.createDataFrame(docs, frames.DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, known.where("doc_id % 5 <> 0").union(spark.createDataFrame([(None, 1, 1), (3, 1, None)], known.schema)))
    got = {r.doc_id: r.toxicity for r in toxicity.scored(frame.withColumn("toxicity", F.lit("mine")), model).collect()}
    held = [i for i in range(0, 900, 5)]
    right = sum((got[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs)
    assert got[1000] == got[1001] == got[1002] < 0.5                       # null, empty, blank


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """Long texts count, none is left out of the shards, and the order of the rows makes no difference."""
    monkeypatch.setattr(toxicity, "PIECE", 60)
    docs = [(i, frames.prose(i, 20) + (" vilething " + "plain words here " * 6_500 if i % 4 == 0 else ""), "en") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert min(len(text) for i, text, _ in docs if i % 4 == 0) > 100_000
    rows = toxicity.labelled(frame, labels).collect()
    assert len(rows) == 200 and 20 < sum(r.held for r in rows) < 60
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.scored(frame, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in got) >= 190
    again = toxicity.train(frame.orderBy("text").coalesce(2), labels)
    assert np.array_equal(again.tables, model.tables) and again.bias == model.bias and np.array_equal(again.thresholds, model.thresholds)


def test_toxicity_without_labels(spark):
    frame = frames.edge_frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame, none)
    assert all(0 <= r.toxicity < 0.5 for r in toxicity.scored(frame, model).collect())
    assert toxicity.scored(frames.empty_frame(spark), model).count() == 0


# --- 2 suffix-array dedup

@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats(spark, small, hot):
    rows = [*small, *((number + 10_000, text) for number, text, *_ in frames.edge_rows())]
    rows += [(20_000 + k, "y" * k) for k in (99, 100, 101, 350)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")
    got = {r.id: (r.n_bytes, bytes(r.kept)) for r in repeats.without_repeats(docs, hot=hot).collect()}
    assert got == frames.without_repeats(rows)


def test_repeats_near_copies(spark):
    pick, base = random.Random(4), frames.prose(9, 400)
    rows = [(0, base)]
    for k in range(1, 60):
        at, size = pick.randrange(len(base)), pick.randrange(1, 30)
        rows.append((k, base[:at] + frames.prose(k, 2)[:size] + base[at + pick.randrange(40):] + base[:pick.randrange(300)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_bytes, bytes(r.kept)) for r in repeats.without_repeats(docs).collect()}
    assert got == frames.without_repeats(rows)


def test_repeats_edges(spark):
    got = repeats.without_repeats(frames.edge_frame(spark).withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id"))))
    rows = got.collect()
    assert len(rows) == 19
    assert next(r for r in rows if r.id is None).spans == []
    assert repeats.without_repeats(frames.empty_frame(spark)).count() == 0


# --- 3 Jaccard join

def test_jaccard(spark, small):
    pick, rows = random.Random(6), [*small[:60], *((r[0] + 10_000, r[1]) for r in frames.edge_rows())]
    base = frames.prose(11, 120).split()
    for k in range(80):                                                    # a family whose ends drift apart
        words = base.copy()
        for _ in range(pick.randrange(0, 9)):
            words[pick.randrange(len(words))] = f"n{pick.randrange(999)}"
        rows.append((30_000 + k, " ".join(words[:pick.randrange(90, 121)])))
    docs = spark.createDataFrame([*rows, rows[70]], "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got == frames.component_of(rows)


def test_jaccard_edges_and_stage(spark):
    frame = frames.edge_frame(spark).withColumn("doc_id", F.when(F.col("doc_id") != 13, F.col("doc_id")))
    rows = jaccard.components(frame).collect()
    assert len(rows) == 19 and next(r for r in rows if r.id is None).component_id is None
    assert jaccard.components(frames.empty_frame(spark)).count() == 0
    kept = jaccard.dedup_stage(spark, frames.edge_frame(spark), SMALL)
    assert kept.columns == frames.edge_frame(spark).columns
    expected = {n for n, (_, c) in frames.component_of([r[:2] for r in frames.edge_rows()]).items() if n == c}
    assert {r.doc_id for r in kept.collect()} == expected


def test_dedup_stage_keeps_one_of_repeated_rows(spark):
    rows = [*frames.edge_rows(), *[frames.edge_rows()[7]] * 3, (4, "another text of this id", "en", None, 3), *[(None, "no id", "en", "a", 5)] * 2]
    kept = jaccard.dedup_stage(spark, spark.createDataFrame(rows, frames.DOCUMENTS), SMALL)
    expected = {n for n, (_, c) in frames.component_of([r[:2] for r in frames.edge_rows()]).items() if n == c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*expected, 4, None, None])
    assert [r.text for r in kept.where("doc_id = 8").collect()] == [frames.edge_rows()[7][1]]


def test_blocks_skip_nothing_that_links():
    pick = random.Random(8)
    sizes = np.sort(np.array([pick.randrange(4, 30) for _ in range(60)]))
    places = np.concatenate([np.sort(np.array([pick.randrange(n) for _ in range((sizes == n).sum())])) for n in np.unique(sizes)])
    leaders = np.arange(60)
    got = set(map(tuple, jaccard.block_pairs(sizes, places, leaders).tolist()))
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60)
                if min(sizes[i] - places[i], sizes[j] - places[j]) * 7 >= 3 * (sizes[i] + sizes[j]) and 4 * sizes[i] >= 3 * sizes[j]}
    assert got == expected


# --- 4 language ID

def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs.where(language.training_rows()))
    got = language.predict(docs.where(~language.training_rows()), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    edges = {r.doc_id: r for r in language.predict(frames.edge_frame(spark), model).collect()}
    assert [edges[k].lang_pred for k in (1, 2, 3, 17)] == ["und"] * 4 and edges[1].lang_score == 0
    assert all(0 <= r.lang_score <= 1 for r in edges.values()) and edges[12].lang_pred in model.languages
    assert language.predict(frames.empty_frame(spark), model).count() == 0
    assert edges[4].score == "mine"


def test_language_counts_everything(spark):
    rows = [(k, "ab" * (k + 1), "x" if k % 2 else "y", "", 0) for k in range(40)]
    model = language.train(spark.createDataFrame(rows, frames.DOCUMENTS).repartition(5))
    table, expected = language.letters_table(), {}
    for _, text, lang, *_ in rows:
        expected.setdefault(lang, np.zeros(1 << model.bits))
        expected[lang] += np.bincount(language.ngram_buckets(language.letter_codes(text, table), model.bits), minlength=1 << model.bits)
    for k, lang in enumerate(model.languages):
        own = expected[lang] + 0.5
        assert np.allclose(model.weights[:, k], np.log(own / own.sum()), atol=1e-4)


def test_language_stage(spark):
    frame = frames.edge_frame(spark)
    kept = language.filter_stage(spark, frame, SMALL)
    assert kept.columns == frame.columns
    assert not {1, 2, 3, 17} & {r.doc_id for r in kept.collect()} and kept.count() == 15
    unlabelled = language.filter_stage(spark, frame.withColumn("lang", F.lit(None).cast("string")), SMALL)
    assert unlabelled.count() == 15


def test_language_stage_rejects_undetermined_texts_only(spark):
    import inspect

    assert list(inspect.signature(language.filter_stage).parameters) == ["spark", "docs", "sf_dir"]
    frame = spark.createDataFrame([*frames.edge_rows(), (90, "%% 7 q ##", "en", "a", 9), (91, "%% 7 ##", "en", "a", 7)], frames.DOCUMENTS)
    kept = {r.doc_id for r in language.filter_stage(spark, frame, SMALL).collect()}
    assert 90 in kept and 91 not in kept


# --- 5 LM scoring

def test_lm(spark, small):
    rows = [*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows())]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    train = [(n, t) for n, t in rows if n % 7 != 2]
    model, words = lm.train(spark.createDataFrame(train, "doc_id long, text string"), bits=1 << 22, top=50)
    counts = Counter(w for _, t in train for w in [*(t or "").encode().lower().split(), b"\0end"])
    total, distinct = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (total, distinct)
    got = lm.score(docs, model, words).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        tokens = [*(texts[r.id] or "").encode().lower().split(), b"\0end"]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert abs(r.base_score - base) < 1e-9 * abs(base) + 1e-12 and r.score <= 0


def test_bloom_counts():
    bounds, pick = lm.level_bounds(), np.random.default_rng(1)
    grams = pick.integers(0, 1 << 64, 5000, np.uint64)
    counts = np.minimum(pick.zipf(1.5, 5000), 1 << 40)
    table = lm.Filter(np.zeros((lm.SHARDS, 1 << 14), np.uint8))
    for gram, level in zip(grams, lm.levels_of(counts, bounds)):
        one = np.full(level, gram)
        table.add(int(lm.shard_of(one)[0]), one, np.arange(1, level + 1))
    read = table.counts(grams)
    assert (read >= counts / lm.BASE - 1).all()                              # never below its level
    assert np.mean(np.abs(read - counts) <= np.maximum(0.5, 0.4 * counts)) > 0.9
    assert np.mean(table.counts(pick.integers(0, 1 << 64, 5000, np.uint64)) > 0) < 0.1


def test_lm_drops_rare_grams_only_when_full(spark):
    counts = spark.createDataFrame([(k, 1 + k % 5) for k in range(1000)], "gram long, n long")
    assert lm.least_count(counts, 1 << 20) == 1
    tight = lm.least_count(counts, 8 * lm.FILL * 100)
    assert tight >= 5
    assert lm.least_count(spark.createDataFrame([], "gram long, n long"), 64) in (1, 1001)


def test_lm_keeps_every_gram_at_any_size(spark, small):
    """A filter beyond the broadcast bound loses nothing: the same scores as from a broadcast one."""
    docs = spark.createDataFrame([*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows()), small[0]], "doc_id long, text string")
    model, words = lm.train(docs, top=50)
    routed, routed_words = lm.train(docs, bits=1 << 12, top=50)
    assert isinstance(model.filter, lm.Filter) and isinstance(routed.filter, lm.StoredFilter)
    expected = sorted(map(tuple, lm.score(docs, model, words).collect()))
    got = sorted(map(tuple, lm.score(docs, routed, routed_words).collect()))
    assert len(got) == len(small) + 19
    for a, b in zip(expected, got):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9)
    assert sum(np.unpackbits(model.filter.shards[k]).sum() for k in range(len(model.filter.shards))) > 0


def test_lm_counts_pairs_seen_once(spark, small):
    counted = {r.gram: r.n for r in lm.count_ngrams(spark.createDataFrame(small, "doc_id long, text string")).collect()}
    words, pairs = Counter(), Counter()
    for _, text in small:
        tokens = [*(text or "").encode().lower().split(), b"\0end"]
        words.update(tokens)
        pairs.update(zip([None, *tokens], tokens))
    assert sum(1 for g in counted if g & 1) == len(pairs) and 1 in pairs.values()
    assert Counter(n for g, n in counted.items() if g & 1) == Counter(pairs.values())
    assert Counter(n for g, n in counted.items() if not g & 1) == Counter(words.values())
    one = spark.createDataFrame([(1, "only here")], "doc_id long, text string")
    model, _ = lm.train(one)
    tokens = lm.hashes_of(b"only here", start := lm.Hashes())
    assert (model.filter.counts(lm.bigrams(tokens, start[lm.START])) >= 1).all()


def test_lm_filter_follows_the_entries():
    for entries in (0, 1, 1000, 2_000_000, 16_777_216, 16_777_217, 10 ** 9):
        shards, size = lm.shape_of(entries)
        assert max(entries * lm.FILL, lm.SHARDS * 64) <= shards * size * 8 <= max(2 * entries * lm.FILL, lm.SHARDS * 64)
        assert size * 8 <= lm.SHARD_BITS
    grams = np.random.default_rng(2).integers(0, 1 << 64, 1000, dtype=np.uint64)
    for shards in (1, 16, 64, 4096):
        of = lm.shard_of(np.sort(grams), shards)
        assert of.min() >= 0 and of.max() < shards and (np.diff(of) >= 0).all()


def test_lm_empty(spark):
    model, words = lm.train(frames.empty_frame(spark), bits=1 << 16)
    rows = lm.score(frames.edge_frame(spark), model, words).collect()
    assert len(rows) == 19 and all(r.base_score == 0 and r.n_known == 0 for r in rows)
    assert lm.score(frames.empty_frame(spark), model, words).count() == 0


# --- 6 decontamination

def test_decontamination(spark, small):
    items = [(1, small[3][1][:400]), (2, "short item"), (3, ""), (4, None), (None, "Alpha beta"), (30, small[3][1][50:500]), (31, "日本語 été")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [*small[:50], *((r[0] + 10_000, r[1]) for r in frames.edge_rows()), (40_000, "a SHORT-item, alpha; beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("mine"))
    named = [("" if i is None else i, t) for i, t in items]
    for block in (1 << 20, 300):
        got = decontam.contamination(docs, benchmark, block_bytes=block).collect()
        for r in got:
            n, hit, found = frames.hits(r.text, named)
            assert (r.n_words, len(r.hit_words), r["items"]) == (n, hit, sorted(found)), (block, r.doc_id)
    none = decontam.contamination(docs, benchmark.where("false")).agg(F.sum(F.size("hit_words"))).first()[0]
    assert none == 0
    assert decontam.contamination(frames.empty_frame(spark), benchmark).count() == 0


def test_decontamination_stage(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    rows = [*frames.edge_rows(), (50, f"Before. {item} After.", "en", "s", 1), (51, item, "en", "s", 1)]
    frame = spark.createDataFrame(rows, frames.DOCUMENTS).withColumn("hit_spans", F.lit("mine"))
    kept = {r.doc_id: r for r in decontam.remove_stage(spark, frame, SMALL).collect()}
    assert set(kept) == {r[0] for r in rows} - {51}
    assert kept[50].text.startswith("Before. ") and kept[50].text.endswith(" After.") and kept[50].n_chars == len(kept[50].text) < 30
    assert all(kept[r[0]].text == r[1] and kept[r[0]].n_chars == r[4] for r in rows[:-2]) and kept[50].hit_spans == "mine"


# --- 7 quality rules

def test_quality_measures(spark, small):
    rows = [*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows()), (30_000, "a b c d e a b c d e a b c d e x"), (30_001, "r\n\nr\n r \nr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("mine"))
    table = quality.measured(docs).withColumn("base_failed", quality.base_failed())
    for r in table.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == frames.quality(dict(rows)[r.doc_id])
    assert quality.measured(frames.empty_frame(spark)).count() == 0


def test_quality_order_never_changes_the_verdict(spark, small):
    table = quality.measured(spark.createDataFrame(small, "doc_id long, text string"))
    rules = quality.default_rules()
    ordered = quality.ordered(table, rules, sample_rows=100)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    verdicts = [[r[0] for r in table.orderBy("doc_id").select(quality.rejected(order)).collect()] for order in (rules, rules[::-1], ordered)]
    assert verdicts[0] == verdicts[1] == verdicts[2] and any(verdicts[0]) and not all(verdicts[0])
    assert quality.ordered(table.where("false"), rules)


def test_quality_is_native(spark):
    plan = quality.query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 8 BPE

@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))


def library():
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_bpe(spark, small):
    tokenizer = library()
    pick = random.Random(1)
    letters = [chr(c) for c in range(32, 127)] * 3 + [chr(c) for c in range(0xA0, 0x250)] + [chr(pick.randrange(0x300, 0xD7FF)) for _ in range(200)]
    rows = [*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows())]
    rows += [(20_000 + k, "".join(pick.choices(letters, k=pick.randrange(50)))) for k in range(300)]
    rows += [(30_000, "a <|endoftext|>b<|startoftext|> ΣΑΣ İ aaaaaaaa!!!!"), (30_001, "re" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("decoded", F.lit("mine"))
    for r in bpe.with_tokens(docs, bpe.tokenizer_path()).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.with_tokens(frames.empty_frame(spark), bpe.tokenizer_path()).count() == 0


def test_bpe_digests(spark):
    tokenizer = library()
    for r in bpe.query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_on_a_small_vocabulary():
    """Every word over three letters against the textbook merge loop."""
    from itertools import product

    merges = [("a", "b"), ("b", "b"), ("a", "a"), ("ab", "c"), ("aa", "ab"), ("c", "ab"), ("bb", "bb"), ("aa", "aa")]
    tokens = [*bpe.byte_symbols(), *dict.fromkeys(a + b for a, b in merges)]
    vocabulary = {t: k for k, t in enumerate(tokens)}
    encoder = bpe.Encoder(bpe.compile_automaton(vocabulary, merges))
    rank = {pair: k for k, pair in enumerate(merges)}
    for size in range(1, 8):
        for word in map("".join, product("abc", repeat=size)):
            parts = list(word)
            while True:
                best = min((rank.get(p, 99) for p in zip(parts, parts[1:])), default=99)
                if best == 99:
                    break
                at = next(i for i, p in enumerate(zip(parts, parts[1:])) if rank.get(p, 99) == best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            assert [tokens[t] for t in encoder.word(word)] == parts


def test_bpe_stage(spark):
    frame = frames.edge_frame(spark)
    out = bpe.encode_stage(spark, frame.drop("token_ids", "n_tokens"), SMALL)
    assert out.columns == [*frame.drop("token_ids", "n_tokens").columns, "token_ids", "n_tokens"] and out.count() == 19


# --- 9 secrets

def test_secrets(spark, small):
    pick = random.Random(3)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "\"", "'", ":", "=", "  ", "abc123", "ABCDEFGH", "AKIA", "AKIA1234567890ABCD",
             "deadbeef" * 4, "é", "==", "=secret", "\n", "g"]
    rows = [*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows())]
    rows += [(20_000 + k, "".join(pick.choices(parts, k=pick.randrange(30)))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secret_kinds", F.lit("mine"))
    base = {rule.kind for rule in secrets.BASE}
    for r in secrets.with_secrets(docs).collect():
        spans = [f"{k}:{a}:{b}" for k, a, b in zip(r.secret_kinds, r.secret_starts, r.secret_ends) if k in base]
        assert spans == frames.secret_spans(r.text), r.text
    assert secrets.with_secrets(frames.empty_frame(spark)).count() == 0


def test_secret_digests(spark):
    texts = texts_of(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for r in secrets.query(spark, SMALL).collect():
        spans = frames.secret_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))


def test_more_kinds():
    scanner = secrets.compile_rules()
    text = "ghp_" + "a1B2" * 9 + " xoxb-123456789012 eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJlc2lnbmF0 -----BEGIN RSA PRIVATE KEY-----\nMIIabc\n"
    assert {scanner.rules[r].kind for _, _, r in secrets.scan(text.encode(), scanner)} >= {"github", "slack", "jwt", "private_key"}


def test_secret_stage(spark):
    frame = frames.edge_frame(spark)
    out = {r.doc_id: r for r in secrets.redact_stage(spark, frame, SMALL).collect()}
    assert out[18].text == "[ASSIGN] [ACCESS] [HEX]" and out[18].n_chars == len(out[18].text)
    assert out[5].text == frames.edge_rows()[4][1] and out[5].secret_kinds == "mine" and len(out) == 18


# --- 10 token counts

def test_token_counts(spark, small):
    vocabulary = tokencount.read_vocabulary(tokencount.vocabulary_path())
    tokenizer = Tokenizer(models.Unigram(vocabulary.pieces, unk_id=vocabulary.unknown, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always", split=True)])
    pick = random.Random(2)
    letters = [chr(c) for c in range(32, 127)] * 3 + [chr(pick.randrange(0xA0, 0xD7FF)) for _ in range(300)] + ["▁"]
    rows = [*small, *((r[0] + 10_000, r[1]) for r in frames.edge_rows())]
    rows += [(20_000 + k, "".join(pick.choices(letters, k=pick.randrange(50)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    for r in tokencount.with_counts(docs, vocabulary).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text or "").ids), r.text
    assert tokencount.with_counts(frames.empty_frame(spark), vocabulary).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_count_ties_and_unknowns(fallback):
    """A vocabulary full of ties, with unknown characters fused or given by their bytes."""
    from itertools import product

    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0), ("aba", -3.0)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter = tokencount.Counter(tokencount.Vocabulary(pieces, 0))
    for size in range(1, 7):
        for word in map("".join, product("abé", repeat=size)):
            assert counter.word(word)[0] == len(tokenizer.encode(word).ids), word


def test_folds(spark):
    from plumbline.llm.common import remainder

    rows = spark.createDataFrame([(1,), (22,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 7).alias("fold")).collect()
    assert {r.doc_id: r.fold for r in rows} == {1: zlib.crc32(b"1") % 7, 22: zlib.crc32(b"22") % 7, None: 0}
