"""Work that must not be repeated or moved about: sets, member tests, labelled texts, words."""

import gc
import weakref

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, toxicity
from plumbline.llm.common import written
from tests.llm import frames


def maps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_overlaps_make_each_side_of_sets_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "id long, text string")
    owners = jaccard.scan(docs).where("part is null").select(F.col("d1").alias("node"), "id")
    low, high = sorted(r.node for r in owners.collect())
    pairs = written(spark.createDataFrame([(high, low)], "a long, b long"), "pairs")
    found = jaccard.overlaps(jaccard.Source(docs, written(owners, "owners")), pairs)
    assert [(r.a, r.b, r.na, r.nb, r.both) for r in found.collect()] == [(high, low, 2, 2, 1)]
    assert maps(found) == 3                  # sets of a, sets of b, the comparison


def test_member_tests_are_stored_and_bounded_by_bitmaps(spark, monkeypatch):
    """Of a leader's members that are as far from it as another leader is, only those are tested whose bitmaps allow a link."""
    texts = {1: " ".join(f"w{i}" for i in range(104)), 2: " ".join(f"w{i}" if i >= 24 else f"o{i}" for i in range(104)),
             3: " ".join(f"w{i}" if i < 90 else f"p{i}" for i in range(104)), 4: " ".join(f"w{i}" if i >= 14 else f"o{i}" for i in range(104))}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    rows = {r.id: r for r in jaccard.scan(docs).where("part is null").collect()}
    node = {k: r.d1 for k, r in rows.items()}
    sets = {k: frames.shingles(t) for k, t in texts.items()}
    found = {node[k]: jaccard.shingle_sets(pa.array([texts[k]]))[0] for k in texts}
    both = lambda a, b: len(sets[a] & sets[b])
    far = lambda a, b: 1 - both(a, b) / len(sets[a] | sets[b])
    assert far(1, 2) > 0.25 > max(far(1, 3), far(1, 4)) and far(2, 4) < 0.25 < far(2, 3)
    only = lambda a, b: np.setdiff1d(found[node[a]], found[node[b]], True).tobytes()
    frame = spark.createDataFrame
    nodes = frame([(node[k], r.parity) for k, r in rows.items()], "rep long, parity array<long>")
    led = frame([(node[k], node[1], 100, 100, both(1, k), far(1, k), only(k, 1), only(1, k)) for k in (3, 4)],
                "a long, b long, na long, nb long, both long, distance double, plus binary, minus binary")
    seen, whole = [], jaccard.derived

    def recorded(source, members):
        seen.append((bool(members.inputFiles()), [r.a for r in members.collect()]))
        return whole(source, members)

    monkeypatch.setattr(jaccard, "derived", recorded)
    source = jaccard.Source(docs, frame([(node[k], k) for k in texts], "node long, id long"))
    links = jaccard.member_links(
        source, nodes, frame([(node[1], node[2], 100, 100, both(1, 2))], "a long, b long, na long, nb long, both long"), led,
        frame([(node[1], max(far(1, 3), far(1, 4))), (node[2], 0.0)], "leader long, radius double"),
        frame([(node[k], node[1]) for k in (1, 3, 4)], "node long, component long"),
        frame([], "token long, n int, pos int, leader long, rep long, component long"))
    assert [(r.a, r.b) for r in links.collect()] == [(node[4], node[2])]
    assert seen == [(True, [node[4]])]


def test_postings_travel_in_arrays_and_once_for_each_set(spark, monkeypatch):
    """Copies of a text are made into a set where its owner is, and a posting becomes a row only if two sets have its token."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[k % 7:k % 7 + 60 + k]) for k in range(40)] + [" ".join(f"lone{k}x{i}" for i in range(80)) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k % 3]) for k in range(300)] + [(None, texts[0]), (None, "not owned by any row"), (2000, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(8)
    classes = written(jaccard.scan(docs).where("part is null and n > 0 and id is not null").groupBy("d1", "n").agg(F.min("id").alias("id")), "classes")
    levels = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    monkeypatch.setattr(jaccard, "HELD", 300)
    monkeypatch.setattr(jaccard, "PIECE", 5)
    steps, whole = [], jaccard.arrow_map

    def recorded(*given):
        steps.append(whole(*given))
        return steps[-1]

    monkeypatch.setattr(jaccard, "arrow_map", recorded)
    found = jaccard.postings(docs, levels, classes)
    expected, having = set(), {}
    for text in dict.fromkeys(texts):
        own = jaccard.shingle_sets(pa.array([text]))[0]
        for pos, token in enumerate(jaccard.prefix(own, levels).astype(np.int64).tolist()):
            expected.add((token, jaccard.node_of(own), len(own), pos))
            having.setdefault(token, set()).add(jaccard.node_of(own))
    shared = {row for row in expected if len(having[row[0]]) > 1}
    assert sorted(map(tuple, found.collect())) == sorted(shared) and 0 < len(shared) < len(expected)
    sent = steps[0].selectExpr("octet_length(token) div 8 AS k").agg(F.sum("k"), F.max("k")).first()
    assert tuple(sent) == (len(expected), 5)


def test_several_sets_have_the_minima_and_bitmaps_of_each(spark):
    texts = ["", "one", "a b c d e f g", " ".join(f"w{i}" for i in range(3000)), "", " ".join(f"v{i}" for i in range(90))]
    sets = jaccard.shingle_sets(pa.array(texts))
    rows = {r.id: r for r in jaccard.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)).where("part is null").collect()}
    for k, own in enumerate(sets):
        assert rows[k].n == len(own)
        assert rows[k].minima == [int((own * odd).min().astype(np.int64)) if len(own) else 0 for odd in jaccard.ODD]
        assert rows[k].parity == jaccard.parity(own).view(np.int64).tolist() and (rows[k].fine is None) == (len(own) <= 1024)


def test_pairs_of_lists_are_told_apart_in_order():
    pairs = np.random.default_rng(3).integers(-4, 4, (500, 2))
    assert np.array_equal(jaccard.distinct_pairs(pairs), np.unique(pairs, axis=0))
    assert jaccard.distinct_pairs(pairs[:0]).shape == (0, 2) and len(jaccard.distinct_pairs(pairs[:1])) == 1


def test_labelled_texts_are_dealt_before_they_become_buckets(spark, monkeypatch):
    stored = []

    def recorded(df, label):
        stored.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(toxicity, "written", recorded)
    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} word{i % 7}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    (label, plan), = stored
    assert label == "labelled" and plan.index("MapInArrow") < plan.index("RepartitionByExpression")   # printed from the last step down
    assert {r.doc_id for r in toxicity.labelled(docs, labels).collect()} == set(range(30))


def test_labelled_texts_are_shuffled_once_however_many_labels(spark, monkeypatch):
    """No table of labels is small enough for a broadcast: the texts still cross one exchange only, and their buckets are stored by zstd."""
    stored = []

    def nodes(node):
        return [node, *(n for i in range(node.children().size()) for n in nodes(node.children().apply(i)))]

    def recorded(df, label):
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.initialPlan() if plan.nodeName().startswith("Adaptive") else plan
        sent = [n for n in nodes(plan) if n.nodeName() == "Exchange" and "text#" in n.output().toString()]
        out = written(df, label)
        stored.append((len(sent), [f.endswith(".zstd.parquet") for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(toxicity, "written", recorded)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    limit, codec = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.parquet.compression.codec"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} word{i % 7}", "en") for i in range(60)], "doc_id long, text string, lang string")
        toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    (sent, tight), = stored
    assert sent == 1 and tight and all(tight)
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec


def test_labels_meet_every_row_of_their_text(spark):
    """Repeated ids, both labels of an id, labels without a text, null ids, texts and labels, ids that are text."""
    docs = spark.createDataFrame([("1", "one", "en"), ("1", "one more", None), ("2", "two", "de"), ("2", "two", "de"), ("3", None, "en"), (None, "none", "en"),
                                  ("4", "", "en"), ("5", "unlabelled", "en"), ("7", "null label", "en")], "doc_id string, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (4, 1), (6, 0), (7, None), (7, 2)], "doc_id int, toxic int")
    for shards in (1, 3):
        rows = toxicity.labelled_texts(docs, labels, shards).collect()
        assert sorted((r.doc_id, r.lang or "", r.toxic, r.text) for r in rows) == [
            (1, "", 0, "one more"), (1, "", 1, "one more"), (1, "en", 0, "one"), (1, "en", 1, "one"), (2, "de", 0, "two"), (2, "de", 0, "two"), (4, "en", 1, "")]
        assert len({(r.doc_id, r.shard, r.held) for r in rows}) == 3 and {r.shard for r in rows} <= set(range(shards))


def test_stretches_are_encoded_once():
    encoder = bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))
    split, asked = regex.compile(bpe.SPLIT).findall, []

    def words(text):
        asked.append(text)
        return split(text)

    text = "some words, some words, some\x85words"
    assert bpe.encode(text, encoder, words) == [t for w in split(text) for t in encoder.word(w)]
    assert asked == ["some", "words,", "words"]
    for text in ("a\x1cb c\x1f", "x" * 200 + " y", "aé b　c"):
        assert bpe.encode(text, encoder, split) == [t for w in split(text) for t in encoder.word(w)]


def test_words_in_use_stay_known():
    kept = bpe.Recent(4)
    for k in range(10):
        kept.put(k, (k,))
        assert kept[0] == (0,) and len(kept) + len(kept.older) <= 4
    assert kept[1] is None


def test_encoder_holds_little():
    """No table repeats what another holds: word ends are looked up whole, single words are stored once."""
    encoder = bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))
    end, open_nodes, labels, nodes = encoder.a.end, [("", encoder.reach)], set(), 0
    while open_nodes:
        label, node = open_nodes.pop()
        for letter, (token, following) in node.items():
            nodes += 1
            open_nodes.append((label + letter, following))
            if token >= 0:
                labels.add(label + letter)
    assert end and labels == {label for label in encoder.a.ids if not label.endswith(end)}
    assert nodes < 1.5 * len(encoder.a.ids)
    split = regex.compile(bpe.SPLIT).findall
    bpe.encode("some words, some", encoder, split)
    assert encoder.chunks["some"] is encoder.words["some"]


def test_dropped_encoder_gives_memory_back():
    """A worker that goes on with other tasks keeps nothing of the tables, nor of what was frozen with them."""
    encoder = bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))
    table = weakref.ref(encoder.words)
    encoder.settle()
    assert gc.get_freeze_count() > 0
    left = bpe.Recent(4)
    left.older = {"left": left}          # a cycle
    found = weakref.ref(left)
    gc.freeze()
    del left, encoder
    assert table() is None and found() is None and gc.get_freeze_count() == 0
