"""The registered text queries and the pipeline on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert name in entry_point.queries()
    rows = QUERIES[name](spark, SMALL)
    n = rows.count()
    assert {"pipeline": 0 < n < 200, "op11_whitening": n == 2000, "op12_vector_codes": n == 500}.get(name, n == 200)


def test_pipeline_against_brute_force(spark):
    """Every stage's decision recomputed in plain Python from the stage before it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept == {n: t for n, t in start.items() if any(c.isalpha() for c in t or "")}
    single = {n: kept[n] for n, (_, c) in frames.component_of(kept.items()).items() if n == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    encoder = bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))
    import regex

    words = regex.compile(bpe.SPLIT).findall
    untouched = 0
    for number, text in single.items():
        n, hit, _ = frames.hits(text, items)
        if n and n == hit:
            assert number not in result
            continue
        row = result[number]
        if not hit and not frames.secret_spans(text):
            untouched += row.text == text
        assert frames.hits(row.text, items)[1] == 0 and not frames.secret_spans(row.text)
        assert row.token_ids == bpe.encode(row.text, encoder, words) and row.n_tokens == len(row.token_ids)
    assert set(result) <= set(single) and untouched > 0.5 * len(single)


def test_pipeline_decodes(spark):
    import hashlib

    rows = corpus_pipeline.run(spark, SMALL).collect()
    encoder = bpe.Encoder(bpe.compiled(bpe.tokenizer_path()))
    special = {number: token for token, number in encoder.a.special.items()}
    assert rows
    for row in rows:
        decoded = bpe.decode(row.token_ids, encoder.a.labels, special)
        assert decoded and row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_only_the_entry_point_guards_the_import():
    import pathlib

    root = pathlib.Path(entry_point.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "plumbline" / "llm").glob("*.py")]:
        assert "except ImportError" not in path.read_text() and "except ModuleNotFoundError" not in path.read_text()
