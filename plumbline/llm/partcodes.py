"""Vector code compression: parts of integer vectors become indexes into trained codebooks.

Distances come from tables instead of arithmetic on rows. For each dimension, the distinct integers of a
block of rows form a dictionary, and the squared differences of every one of them to all codebook entries are
tabulated once. A part's distances to all entries are then gathers of table rows by the dictionary codes of its
dimensions, added up. A dictionary belongs to one block, so it is bounded by the block's rows whatever the
values are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, discard, share, slices, written
from plumbline.llm.vectors import BITS, LOW, ROWS, Totals, integers, magnitude, merged, packed_rows, unpacked_rows, vectors

BLOCK = 2048                  # rows


class Codebooks:
    """Entries of every part: an array parts x entries x width of integers."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.largest = entries, magnitude(entries)
        self.parts, self.size, self.width = entries.shape
        self.dims = self.parts * self.width

    def text(self) -> str:
        """Decimal components by part, entry and position."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def assigned(self, x: np.ndarray):
        """Per row and part the nearest entry, ties to the lower index, and per row the sum of the squared
        distances: exact, in the narrowest integers that hold them, Python's for very large values."""
        bound = self.dims * (2 * max(self.largest, magnitude(x)) + 1) ** 2
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
        index, error = np.zeros((len(x), self.parts), np.uint8), np.zeros(len(x), kind)
        for part in range(self.parts):
            distances = 0
            for at in range(self.width):
                values, codes = dictionary(x[:, part * self.width + at])
                table = values.astype(kind)[:, None] - self.entries[part, :, at].astype(kind)
                distances = distances + (table * table)[codes]
            nearest = distances.argmin(axis=1)
            index[:, part] = nearest
            error += distances[np.arange(len(x)), nearest]
        return index, error


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and each row's code in them."""
    low, high = int(column.min()), int(column.max())
    if high - low >= 8 * len(column):
        return np.unique(column, return_inverse=True)
    present = np.zeros(high - low + 1, bool)
    present[column - low] = True
    return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[column - low]


def first_entries(stored: DataFrame, size: int) -> list[bytes]:
    """The vectors of the ``size`` smallest ids, ascending; of several vectors of an id the first as bytes.
    Every task sends that many rows at most."""
    def smallest(batches):
        held = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            usable = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            last = max(held) if len(held) == size else None
            rows = batch.column(1)
            for at in usable if last is None else usable[ids[usable] <= last]:
                number, row = int(ids[at]), rows[int(at)].as_py()
                if number not in held and len(held) == size:
                    if number > last:
                        continue
                    del held[last]
                held[number] = min(row, held.get(number, row))
                last = max(held) if len(held) == size else None
        if held:
            yield {"id": list(held), "x": list(held.values())}

    tops = arrow_map(stored.select("id", "x"), smallest, "id long, x binary").groupBy("id").agg(F.min("x").alias("x"))
    return [bytes(row.x) for row in tops.orderBy("id").limit(size).collect()]


def refined(stored: DataFrame, books: Codebooks, rows: int) -> Codebooks:
    """Every entry replaced by the floor of the mean of the parts that are nearest to it; unused entries
    stay. The sums are exact; the driver gets one for each component of the codebooks."""
    shared, bits = share(stored.sparkSession, books), 64 + rows.bit_length()

    def add_up(batches):
        books = shared.value
        total = Totals(books.parts * books.size * (books.width + 1), bits)
        for batch in slices(batches, BLOCK):
            x = unpacked_rows(batch.column(0).to_pylist(), books.dims)
            index, _ = books.assigned(x)
            for part in range(books.parts):
                nearest, first = index[:, part], part * books.size * (books.width + 1)
                total.add(np.bincount(nearest, minlength=books.size), 0, first)
                for at in range(books.width):
                    column, first = x[:, part * books.width + at], first + books.size
                    for shift, piece in enumerate((column & LOW, column >> np.int64(BITS))):
                        sums = np.bincount(nearest, piece, minlength=books.size)     # below 2 ** 53: exact
                        total.add(sums.astype(np.int64), shift, first)
        yield total.rows()

    sums = merged(arrow_map(stored.select("x"), add_up, ROWS))
    entries, step = books.entries.copy(), books.size * (books.width + 1)
    for part in range(books.parts):
        for entry in range(books.size):
            counted = sums[part * step + entry]
            if counted:
                entries[part, entry] = [sums[part * step + (at + 1) * books.size + entry] // counted for at in range(books.width)]
    return Codebooks(entries)


RESULT = "id long, label string, code string, error long, error_exact string"


def coded(stored: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error, error_exact): two hex digits for each part, and the sum of its squared
    distances; ``error`` is null beyond 64 bits."""
    shared = share(stored.sparkSession, books)

    def task(batches):
        books = shared.value
        for batch in slices(batches, BLOCK):
            index, error = books.assigned(unpacked_rows(batch.column(2).to_pylist(), books.dims))
            error = error.tolist()
            yield {"id": batch.column(0), "label": batch.column(1), "code": [row.tobytes().hex() for row in index],
                   "error": [e if e < 1 << 63 else None for e in error], "error_exact": [str(e) for e in error]}

    return arrow_map(stored.select("id", "label", "x"), task, RESULT)


def compressed(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16,
               size: int = 64, rounds: int = 2, few_labels: int = 100_000) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, error_exact, label_error), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out; repeated rows and null
    ids are coded like others, but null ids start no entry. A shorter vector, or a length that the
    parts don't divide, counts as padded with zeros. With fewer ids than ``size`` the codebooks have fewer
    entries. An empty table gives no rows; without any id there are no codebooks, and code and errors are
    null. ``label_error`` sums the errors of equal labels (as text; nulls together), null beyond 64 bits.
    """
    spark = df.sparkSession

    def whole(batches):
        for batch in slices(batches, 2 * BLOCK):
            rows, lengths, x = integers(batch.column(1))
            yield {"id": batch.column(0).take(rows), "label": batch.column(2).take(rows), "x": packed_rows(x), "length": lengths}

    source = vectors(df, id_col, vec_col, F.col(label_col).cast("string").alias("label"))
    stored = written(arrow_map(source, whole, "id long, label string, x binary, length long"), "integers")
    rows, dims = stored.agg(F.count("*"), F.max("length")).first()
    firsts = first_entries(stored, size)
    if not firsts:
        return stored.select("id", "label", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "long"), ("error_exact", "string"), ("label_error", "long")))), None
    width = max(1, -(-dims // parts))
    start = unpacked_rows(firsts, parts * width).reshape(len(firsts), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = refined(stored, books, rows)
    result = written(coded(stored, books), "codes")
    discard(stored)

    fits = F.col("total") <= F.lit((1 << 63) - 1).cast("decimal(38,0)")
    exact = F.col("error_exact").try_cast("decimal(38,0)")
    totals = written(result.groupBy(F.col("label").alias("of")).agg(F.try_sum(exact).alias("total"), F.count(exact).alias("summed"), F.count("*").alias(
        "rows")).select("of", F.when(fits & (F.col("summed") == F.col("rows")), F.col("total")).cast("long").alias("label_error")), "label-errors")
    if totals.count() <= few_labels:
        totals = F.broadcast(totals)
    return result.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def query(spark, sf_dir):
    """op12: codes and errors of every usable embedding."""
    found, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(books.text().encode()).hexdigest() if books else None
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def oracle(parts: int = 16, size: int = 64, rounds: int = 2) -> str:
    """The same rows in SQL for vectors of one length, every distance computed on its own."""
    def assigned(name: str, books: str) -> str:
        return f"""{name} AS (
  SELECT vec_id, part, entry, distance FROM (
    SELECT k.vec_id, k.part, b.entry, sum((k.x - b.x) * (k.x - b.x)) AS distance,
           row_number() OVER (PARTITION BY k.vec_id, k.part ORDER BY sum((k.x - b.x) * (k.x - b.x)), b.entry) AS place
    FROM pieces k JOIN {books} b ON b.part = k.part AND b.pos = k.pos
    GROUP BY k.vec_id, k.part, b.entry) WHERE place = 1)"""

    steps, books = [], "book0"
    for k in range(rounds):
        steps.append(assigned(f"near{k}", books))
        steps.append(f"""book{k + 1} AS (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT n.part, n.entry, k.pos, CAST(floor(CAST(sum(k.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM near{k} n JOIN pieces k USING (vec_id, part) GROUP BY n.part, n.entry, k.pos) m USING (part, entry, pos))""")
        books = f"book{k + 1}"
    steps.append(assigned("final", books))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
places AS (SELECT vec_id, v, len(v) // {parts} AS width, unnest(range(len(v))) AS i FROM kept),
pieces AS (SELECT vec_id, CAST(i // width AS INTEGER) AS part, CAST(i % width AS INTEGER) AS pos, v[i + 1] AS x FROM places),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {size}),
book0 AS (SELECT part, entry, pos, x FROM starts JOIN pieces USING (vec_id)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM final GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM {books})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest
"""
