"""Embedding whitening with a covariance out of squares only (polarisation).

The vectors become integers, and each distinct one counts once. With n vectors and sums S, the centred
entries y = n*x - S are integers, and tasks add up the exact squares of every y_i and of every sum
y_i + y_j. Half of what the square of a sum has beyond the two single ones is the cross term, so the
covariance is exact until it is divided and handed to ``eigh``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, discard, share, slices, written
from plumbline.llm.vectors import BITS, LOW, ROWS, Totals, integers, magnitude, merged, packed_rows, unpacked_rows, vectors

EXACT_BITS = 51               # centred entries below 2 ** 51 are squared in two limbs
AT_ONCE = 1024                # rows


@dataclass
class Whitening:
    n: int                    # distinct integer vectors
    sums: list[int]           # of each dimension
    largest: int              # absolute integer entry
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))            # falling, of the kept components
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))      # dims x kept components
    explained: list = field(default_factory=list)                                 # shares of the total variance
    identity_error: float | None = None

    @property
    def bits(self) -> int:
        """Of a centred entry's magnitude."""
        return (self.n * self.largest + max(map(abs, self.sums), default=0)).bit_length()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they are enough, else Python's."""
        if self.bits <= EXACT_BITS:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Centred integer rows on the components, each over its standard deviation; flat ones are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (y / self.n).astype(np.float64) @ self.components / np.where(self.variances > 0, np.sqrt(self.variances), np.nan)

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sum of squares of each centred row."""
        if y.dtype == object:
            return [sum(v * v for v in row) for row in y]
        high, low, out = y >> np.int64(BITS), y & LOW, np.zeros(len(y), object)
        for at in range(0, y.shape[1], AT_ONCE):
            h, l = high[:, at:at + AT_ONCE], low[:, at:at + AT_ONCE]
            out += (np.einsum("ij,ij->i", h, h).astype(object) << 2 * BITS) + (np.einsum("ij,ij->i", h, l).astype(object) << BITS + 1)
            out += np.einsum("ij,ij->i", l, l).astype(object)
        return out.tolist()


def fit_list(df: DataFrame, vec_col: str) -> DataFrame:
    """(x, length): every distinct integer vector, as bytes, and the greatest length it came with. Copies
    are merged within tasks before they are shuffled."""
    def task(batches):
        for batch in slices(batches, 4096):
            _, lengths, x = integers(batch.column(0))
            yield {"x": packed_rows(x), "length": lengths}

    rows = arrow_map(df.select(F.col(vec_col).cast("array<double>").alias("v")), task, "x binary, length long")
    return rows.groupBy("x").agg(F.max("length").alias("length"))


def fit(df: DataFrame, *, vec_col: str = "embedding", components: int = 4) -> Whitening:
    """Covariance and components of the distinct integer vectors floor(256 * c) of ``df``.

    Rows whose vector is null or holds null or non-finite entries are left out; repeated ones count once. A
    vector shorter than the longest counts as padded with zeros; an empty table gives n = 0 and no
    component. A component without variance (repeated or too few vectors, constant dimensions) is flat:
    it has no whitened value, and the identity error leaves it out.
    """
    fitted = written(fit_list(df, vec_col), "fit-list")
    head = fitted.agg(F.count("*"), F.max("length")).first()
    n, dims = head[0], head[1] or 0
    if not n or not dims:
        discard(fitted)
        return Whitening(n, [0] * dims, 0)
    bits = 64 + n.bit_length()

    def add_up(batches):
        sums, largest = Totals(dims, bits), 0
        for batch in slices(batches, 4096):
            x = unpacked_rows(batch.column(0).to_pylist(), dims)
            sums.add((x & LOW).sum(axis=0)), sums.add((x >> np.int64(BITS)).sum(axis=0), 1)
            largest = max(largest, magnitude(x))
        rows = sums.rows()
        yield {k: v + extra for (k, v), extra in zip(rows.items(), ([f"max {largest}"], [0], [b""]))}

    totals = written(arrow_map(fitted.select("x"), add_up, ROWS), "sums")
    largest = totals.where("name like 'max%'").agg(F.max(F.substring_index("name", " ", -1).cast("decimal(20,0)"))).first()[0]
    model = Whitening(n, merged(totals.where("name not like 'max%'")), int(largest))
    discard(totals)

    covariance = exact_covariance(fitted, model, dims)
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    least = max(values.max(initial=0), 0) * dims * np.finfo(float).eps * 4
    model.variances = np.where(values[order] > least, values[order], 0.0)
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(dims)])
    model.components = (basis * np.where(signs == 0, 1, signs))[:, order]
    total = float(np.trace(covariance))
    model.explained = [float(v) / total if total > 0 else None for v in model.variances]
    model.identity_error = identity_error(fitted, model, dims)
    discard(fitted)
    return model


def exact_covariance(fitted: DataFrame, model: Whitening, dims: int) -> np.ndarray:
    """dims x dims, divisor n, rounded once at the end. The driver gets dims * (dims + 1) / 2 sums."""
    shared = share(fitted.sparkSession, model)
    bits = 2 * (model.bits + 1) + model.n.bit_length()
    places = dims * (dims + 1) // 2

    def squares(batches):
        model, total = shared.value, Totals(places, bits)
        for batch in slices(batches, AT_ONCE):
            y = np.ascontiguousarray(model.centred(unpacked_rows(batch.column(0).to_pylist(), dims)).T)
            at = 0
            for i in range(dims):                       # place: y_i itself, then y_i + y_j for all later j
                sums = y[i:] + y[i]
                sums[0] = y[i]
                if y.dtype == object:
                    total.add_large((sums * sums).sum(axis=1).tolist(), at)
                else:
                    total.add_squares(sums, model.bits + 1, at)
                at += dims - i
        yield total.rows()

    sums = merged(arrow_map(fitted.select("x"), squares, ROWS))
    firsts = np.cumsum([0, *range(dims, 1, -1)]).tolist()
    out, divisor = np.zeros((dims, dims)), model.n ** 3
    for i, first in enumerate(firsts):
        out[i, i] = sums[first] / divisor
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (sums[first + j - i] - sums[first] - sums[firsts[j]]) / (2 * divisor)
    return out


def identity_error(fitted: DataFrame, model: Whitening, dims: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the fit list
    and the components with variance; null if there are none."""
    shared, kept = share(fitted.sparkSession, model), np.flatnonzero(model.variances > 0)
    if not len(kept):
        return None

    def products(batches):
        model, total = shared.value, np.zeros((len(kept), len(kept)))
        for batch in slices(batches, 4096):
            y = model.whitened(model.centred(unpacked_rows(batch.column(0).to_pylist(), dims)))[:, kept]
            total += y.T @ y
        yield {"place": list(range(total.size)), "total": total.ravel()}

    sums = arrow_map(fitted.select("x"), products, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    found = np.zeros(len(kept) ** 2)
    for row in sums.collect():
        found[row.place] = row.total / model.n
    return float(np.abs(found.reshape(len(kept), -1) - np.eye(len(kept))).max())


RESULT = ("id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double, "
          "identity_error double")


def whitened(df: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``df`` and component: its whitened coordinate, and the vector's exact squared
    distance n * n * |x - S/n| ** 2 from the mean.

    Rows without a usable vector are left out, repeated rows and null ids are not. ``deviation`` is null where it
    exceeds 64 bits; ``deviation_exact`` has all its digits. A flat component has a null ``whitened``, and its
    share ``explained`` is 0, or null where no dimension varies.
    """
    shared = share(df.sparkSession, model)

    def task(batches):
        model = shared.value
        k, dims = model.components.shape[1], len(model.sums)
        for batch in slices(batches, 2048):
            rows, _, x = integers(batch.column(1))
            if not len(rows) or not k:
                continue
            if x.shape[1] < dims:
                x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
            y = model.centred(x)
            exact = [d for d in model.deviations(y) for _ in range(k)]
            ids = batch.column(0).take(rows).to_pylist()
            yield {
                "id": [i for i in ids for _ in range(k)], "component": list(range(1, k + 1)) * len(ids), "n": [model.n] * len(exact),
                "deviation": [d if d < 1 << 63 else None for d in exact], "deviation_exact": [str(d) for d in exact],
                "whitened": [None if np.isnan(v) else v for v in model.whitened(y).ravel().tolist()],
                "explained": model.explained * len(ids), "identity_error": [model.identity_error] * len(exact),
            }

    return arrow_map(vectors(df, id_col, vec_col), task, RESULT)


def query(spark, sf_dir):
    """op11: up to four whitened coordinates of every usable embedding."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitened(df, fit(df)).withColumnRenamed("id", "vec_id")
