"""Whitening, vector codes and fingerprints against brute force, on edge rows too."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import partcodes, simhash, vectors, whitening
from tests.llm import frames

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def edge_vectors(seed=1, n=150, dims=32):
    """Repeated rows and vectors, a null id, unusable, short and empty vectors."""
    pick = random.Random(seed)
    rows = [(k, [pick.gauss(0, 0.3) + 0.1 * (d % 3) for d in range(dims)], pick.choice((0, 1, 2, None))) for k in range(n)]
    rows += [rows[3], (900, rows[4][1], 1), (None, rows[5][1], None), (None, [0.5] * dims, 2)]
    rows += [(901, None, 1), (902, [None] + [0.1] * (dims - 1), 1), (903, [NAN] + [0.1] * (dims - 1), 1), (904, [0.1] * (dims - 1) + [INF], 1)]
    return rows + [(905, [0.25] * 5, 1), (906, [], None), (907, [0.0] * dims, 0)]


def vector_frame(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("id", "v", "x", "n", "code", "error", "component")})


def usable(rows):
    dims = max((len(r[1]) for r in rows if r[1] is not None), default=0)
    out = []
    for number, vector, label in rows:
        if vector is not None and all(c is not None and np.isfinite(np.float32(c)) for c in vector):
            whole = [int(np.floor(256 * float(np.float32(c)))) for c in vector]
            out.append((number, tuple(whole + [0] * (dims - len(whole))), label))
    return out


# --- shared

def test_integers_and_packing():
    column = pa.array([[0.5, -0.001], None, [], [None, 1.0], [NAN], [1e300, -1e300], [3.0]], pa.list_(pa.float64()))
    rows, lengths, x = vectors.integers(column)
    assert rows.tolist() == [0, 2, 5, 6] and lengths.tolist() == [2, 0, 2, 1]
    assert x.tolist() == [[128, -1], [0, 0], [2 ** 63 - 1, -2 ** 63], [768, 0]]
    packed = vectors.packed_rows(x)
    assert vectors.unpacked_rows(packed, 3)[:, :2].tolist() == x.tolist()
    assert len(packed[0]) == 5 and packed[1] == b"\1" and vectors.packed_rows(np.zeros((2, 0), np.int64)) == [b"\1"] * 2
    sliced = column.slice(5)
    assert vectors.integers(sliced)[2].tolist() == x[2:].tolist()


def test_totals_are_exact(spark):
    pick = random.Random(7)
    values = [[pick.randrange(-2 ** 51, 2 ** 51) for _ in range(300)] for _ in range(3)]
    total = vectors.Totals(3, 170)
    total.add_squares(np.array(values), 51)
    total.add_large([10 ** 40, -10 ** 40, -5])
    rows = total.rows()
    frame = spark.createDataFrame([tuple(v[0] for v in rows.values())] * 3, vectors.ROWS)
    assert vectors.merged(frame) == [3 * (sum(v * v for v in row) + more) for row, more in zip(values, (10 ** 40, -10 ** 40, -5))]


# --- 11 whitening

def whitened_by_hand(rows, k=4):
    """(n, sums, covariance, components, variances) from the definition, the covariance in fractions."""
    fit = sorted({r[1] for r in rows})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    y = [[n * v[d] - sums[d] for d in range(dims)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(dims)] for i in range(dims)])
    values, basis = np.linalg.eigh(cov)
    return n, sums, cov, basis[:, ::-1][:, :k], values[::-1][:k]


@pytest.mark.parametrize("bits", [whitening.EXACT_BITS, 0])
def test_whitening(spark, monkeypatch, bits):
    monkeypatch.setattr(whitening, "EXACT_BITS", bits)
    rows = edge_vectors()
    kept = usable(rows)
    n, sums, cov, basis, values = whitened_by_hand(kept)
    frame = vector_frame(spark, rows).repartition(5)
    model = whitening.fit(frame)
    assert (model.n, model.sums) == (n, sums) and model.identity_error < 1e-9
    got = whitening.whitened(frame, model).collect()
    assert len(got) == 4 * len(kept)
    expected = {}
    for number, x, _ in kept:
        expected.setdefault(number, set()).add((sum((n * a - s) ** 2 for a, s in zip(x, sums)), x))
    for r in got:
        options = expected[r.id]
        assert r.deviation in {d for d, _ in options} and r.deviation_exact == str(r.deviation)
        k = r.component - 1
        hand = [(np.array(x) - np.array(sums) / n) @ basis[:, k] / np.sqrt(values[k]) for d, x in options if d == r.deviation]
        assert min(abs(abs(h) - abs(r.whitened)) for h in hand) < 1e-9
        assert abs(r.explained - values[k] / np.trace(cov)) < 1e-12 and r.n == n
    signs = [np.sign(r.whitened * (np.array(x) - np.array(sums) / n) @ basis[:, 0]) for r in got if r.component == 1
             for d, x in expected[r.id] if d == r.deviation and len(expected[r.id]) == 1 and abs(r.whitened) > 1e-9]
    assert len(set(signs)) == 1


def test_whitening_of_large_entries(spark):
    """Entries whose squares exceed 64 bits stay exact; the deviation that fits no long is null."""
    rows = [(k, [float(v) * 2.0 ** 40 for v in (k * k % 7, k % 5, 1)], 0) for k in range(20)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    kept = [(k, tuple(int(256 * c) for c in v), 0) for k, v, _ in rows]
    n, sums, cov, _, values = whitened_by_hand(kept, 3)
    assert (model.n, model.sums) == (n, sums)
    assert np.allclose(model.variances[:2], values[:2], rtol=1e-12) and model.variances[2] == 0    # a constant dimension
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), model).collect()
    for r in got:
        exact = sum((n * a - s) ** 2 for a, s in zip(kept[r.id][1], sums))
        assert r.deviation_exact == str(exact) and r.deviation == (exact if exact < 2 ** 63 else None)
        assert (r.whitened is None) == (r.component == 3)
    assert any(r.deviation is None for r in got) and model.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_whitening_without_vectors(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitened(frame, whitening.fit(frame)).count() == 0


def test_whitening_of_one_vector(spark):
    frame = spark.createDataFrame([(1, [0.5, 1.0], 1), (1, [0.5, 1.0], 1)], SCHEMA)
    got = whitening.whitened(frame, whitening.fit(frame)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2


# --- 12 vector codes

def codes_by_hand(kept, parts=16, size=64, rounds=2):
    dims = len(kept[0][1])
    width = -(-dims // parts)
    cut = [[(x + (0,) * (parts * width - dims))[p * width:(p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    least = {}
    for (number, x, _), pieces in zip(kept, cut):
        if number is not None:
            packed = vectors.packed_rows(np.array([x], np.int64))[0]
            least[number] = min(least.get(number, (packed, pieces)), (packed, pieces))
    books = [[least[i][1][p] for i in sorted(least)[:size]] for p in range(parts)]

    def nearest(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), k) for k, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for pieces in cut:
                groups.setdefault(nearest(p, pieces[p])[1], []).append(pieces[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else entry for k, entry in enumerate(books[p])]
    found = [[nearest(p, pieces[p]) for p in range(parts)] for pieces in cut]
    return books, [("".join(f"{k:02x}" for _, k in row), sum(d for d, _ in row)) for row in found]


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 12, 2.0 ** 30])
def test_vector_codes(spark, scale):
    rows = [(i, None if v is None else [None if c is None else c * scale for c in v], x) for i, v, x in edge_vectors(3)]
    kept = usable(rows)
    books, expected = codes_by_hand(kept)
    found, trained = partcodes.compressed(vector_frame(spark, rows).repartition(4))
    assert trained.text() == ",".join(str(c) for book in books for entry in book for c in entry)
    got = sorted(((r.id, r.label, r.code, r.error_exact, r.label_error) for r in found.collect()), key=str)
    sums = {}
    for (_, _, label), (_, error) in zip(kept, expected):
        sums[label] = sums.get(label, 0) + error
    fits = {label: total if total < 2 ** 63 else None for label, total in sums.items()}
    assert got == sorted(((i, None if label is None else str(label), code, str(error), fits[label])
                          for (i, _, label), (code, error) in zip(kept, expected)), key=str)


def test_vector_codes_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    rows = partcodes.query(spark, SMALL)
    expected = con.execute(partcodes.oracle()).fetchall()
    assert rows.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_vector_codes_without_labels_broadcast(spark):
    frame = vector_frame(spark, edge_vectors(5))
    joined = sorted((str(tuple(r)) for r in partcodes.compressed(frame, few_labels=0)[0].collect()))
    assert joined == sorted(str(tuple(r)) for r in partcodes.compressed(frame)[0].collect())


def test_vector_codes_without_ids(spark):
    assert partcodes.compressed(spark.createDataFrame([], SCHEMA))[0].count() == 0
    found, books = partcodes.compressed(spark.createDataFrame([(None, [0.5, 1.0], 1)], SCHEMA))
    assert books is None and [tuple(r) for r in found.collect()] == [(None, "1", None, None, None, None)]


def test_dictionary():
    for column in ([5, -3, 5, 0], [10 ** 15, 7, -10 ** 15, 7]):
        values, codes = partcodes.dictionary(np.array(column))
        assert values[codes].tolist() == column and values.tolist() == sorted(set(column))


# --- 13 simhash

def bits_by_hand(text, width=3):
    words = frames.WORDS.findall(frames.lowered(text))
    if not words:
        return 0
    size = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, limit=2):
    """Row number to the smallest id linked with it, for (id, fingerprint) rows; null ids link but name nothing."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= limit:
                parent[root(i)] = root(j)
    least = {}
    for k, (number, _) in enumerate(prints):
        if number is not None:
            least[root(k)] = min(number, least.get(root(k), number))
    return [None if number is None else least[root(k)] for k, (number, _) in enumerate(prints)]


@pytest.mark.parametrize("range_rows", [simhash.RANGE, 7])
def test_simhash(spark, range_rows):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + r[0], r[1]) for r in frames.edge_rows()] + [(None, rows[0][1]), (None, "nobody else"), rows[5]]
    prints = [(number, bits_by_hand(text)) for number, text in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("id", "fp", "rank", "part")})
    got = simhash.near_duplicates(frame, range_rows=range_rows).collect()
    expected = [(n, f"{fp:016x}", c) for (n, fp), c in zip(prints, components_by_hand(prints))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert simhash.near_duplicates(frames.empty_frame(spark)).count() == 0


def test_links_of_a_dense_group(spark):
    """Fingerprints around few centres, many within two bits of many: components as by all pairs, and no
    more links than a forest of each batch has."""
    pick = random.Random(11)
    codes = {pick.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = pick.getrandbits(64)
        codes |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(64)}
    codes = sorted(codes)
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    found = simhash.links(frame, range_rows=500)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in edges) and len(edges) < 4 * len(codes)
    parent = {c: c for c in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(c) for c in codes] == components_by_hand([(c, c) for c in codes])


def test_tree_finds_what_all_comparisons_find():
    pick = np.random.default_rng(4)
    for n in (1, 2, 5, 300):
        codes = pick.integers(0, 1 << 12, n, dtype=np.uint64) << np.uint64(26)
        rank = codes.copy()
        for step in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(step)
        codes = codes[np.argsort(rank, kind="stable")]
        tree = simhash.Tree(codes, np.full(n, simhash.FULL))
        pairs = {(int(a), int(b)) for x, y in tree.search(codes, 2) for a, b in zip(x, y)}
        assert pairs == {(i, j) for i in range(n) for j in range(n) if int(codes[i] ^ codes[j]).bit_count() <= 2}
        later = {(int(a), int(b)) for x, y in tree.search(codes, 2, np.arange(1, n + 1)) for a, b in zip(x, y)}
        assert later == {(a, b) for a, b in pairs if a < b}


def test_gray_rank(spark):
    """Neighbours in Gray order differ in one bit, over all codes of a few bits and across the sign."""
    codes = list(range(64)) + [(1 << 63) | c for c in range(64)]
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    order = [r.fp % (1 << 64) for r in frame.orderBy(simhash.gray_rank("fp")).collect()]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order[:64], order[1:64])) and (order[0], order[127] >> 63) == (0, 1)


def test_fingerprint_of_long_text(monkeypatch):
    text = frames.prose(5, 3000)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert simhash.fingerprint(text.encode()) == whole == bits_by_hand(text)


def test_query_digest(spark):
    """The digest column is the hash of the codebooks as text."""
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    books = partcodes.compressed(frame)[1]
    row = partcodes.query(spark, SMALL).first()
    assert row.codebooks_sha256 == hashlib.sha256(books.text().encode()).hexdigest()
