"""Integer vectors out of embeddings, and sums that stay exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import merged_vectors

BITS = 26                                  # of a limb; the highest limb of a sum has the sign
LOW = np.int64((1 << BITS) - 1)
CHUNK = 4096                               # places of a sum that travel in one row


def vectors(df: DataFrame, id_col: str, vec_col: str, *more) -> DataFrame:
    """The id and the vector as doubles, and further expressions; other columns are left alone."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)


def integers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths and integer vectors (floor(256 * c), shorter ones padded with zeros) of the rows
    whose vector is neither null nor holds null or non-finite entries. Beyond 64 bits a value saturates."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths[~valid] = 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = valid & (odd[ends] == odd[ends - lengths])
    rows, kept = np.flatnonzero(good), lengths[good]
    with np.errstate(over="ignore"):
        floors = np.floor(flat[np.repeat(good, lengths)] * 256.0)
    whole = np.clip(floors, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    whole[floors >= 2.0 ** 63] = np.iinfo(np.int64).max
    out = np.zeros((len(rows), int(kept.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < kept[:, None]] = whole
    return rows, kept, out


def packed_rows(x: np.ndarray) -> list[bytes]:
    """One byte string per vector, equal for equal vectors: trailing zeros are cut, and the width of an
    entry is the smallest that the vector allows."""
    if not x.shape[1]:
        return [b"\1"] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    widths = np.full(len(x), 8)
    for width, bound in ((4, 31), (2, 15), (1, 7)):
        widths[(low >= -(1 << bound)) & (high < 1 << bound)] = width
    lengths = np.where(x.any(axis=1), x.shape[1] - (x[:, ::-1] != 0).argmax(axis=1), 0)
    out = [b""] * len(x)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        narrow = x[at].astype(f"<i{width}")
        for i, row, length in zip(at.tolist(), narrow, lengths[at].tolist()):
            out[i] = bytes((width,)) + row[:length].tobytes()
    return out


def unpacked_rows(rows: list[bytes], dims: int) -> np.ndarray:
    """The integer vectors again, padded to ``dims`` entries."""
    out, groups = np.zeros((len(rows), dims), np.int64), {}
    for i, row in enumerate(rows):
        groups.setdefault((row[0], len(row)), []).append(i)
    for (width, size), at in groups.items():
        joined = np.frombuffer(b"".join([rows[i][1:] for i in at]), f"<i{width}")
        out[at, :(size - 1) // width] = joined.reshape(len(at), -1)
    return out


class Totals:
    """Exact sums at numbered places, in limbs, so that no sum can overflow."""

    def __init__(self, places: int, bits: int):
        """``bits``: of the largest sum's magnitude."""
        self.limbs = np.zeros((bits // BITS + 2, places), np.int64)

    def add(self, values: np.ndarray, shift: int = 0, at: int = 0) -> None:
        """Add int64 ``values << (26 * shift)`` at the places from ``at``."""
        span = slice(at, at + len(values))
        for k in range(shift, min(shift + 3, len(self.limbs))):
            last = k == min(shift + 3, len(self.limbs)) - 1
            self.limbs[k, span] += values if last else values & LOW
            values = values >> np.int64(BITS)

    def add_large(self, values, at: int = 0) -> None:
        """Add Python integers at the places from ``at``."""
        for i, value in enumerate(values, at):
            for k in range(len(self.limbs) - 1):
                self.limbs[k, i] += value & int(LOW)
                value >>= BITS
            self.limbs[-1, i] += value

    def add_squares(self, columns: np.ndarray, bits: int, at: int = 0) -> None:
        """Add the sum of squares of each row of int64 ``columns``; below 2 ** bits, at most 1024 of them."""
        if 2 * bits + 10 < 63:
            self.add(np.einsum("ij,ij->i", columns, columns), 0, at)
            return
        high, low = columns >> np.int64(BITS), columns & LOW
        cross = np.einsum("ij,ij->i", high, low)
        self.add(np.einsum("ij,ij->i", low, low), 0, at)
        self.add(cross, 1, at), self.add(cross, 1, at)
        self.add(np.einsum("ij,ij->i", high, high), 2, at)

    def rows(self) -> dict:
        """Rows for ``merged``: carries are settled, so that very many of them can be added."""
        for k in range(len(self.limbs) - 1):
            carry = self.limbs[k] >> np.int64(BITS)
            self.limbs[k] &= LOW
            self.limbs[k + 1] += carry
        pieces = [self.limbs[:, i:i + CHUNK].tobytes() for i in range(0, self.limbs.shape[1], CHUNK)]
        return {"name": [str(len(self.limbs))] * len(pieces), "part": list(range(len(pieces))), "counts": pieces}


ROWS = "name string, part int, counts binary"


def merged(rows: DataFrame) -> list[int]:
    """The sums of all tasks' ``Totals``, in the order of their places; empty without any row. The size
    is that of the places, not of the input."""
    out = []
    for row in sorted(merged_vectors(rows).collect(), key=lambda r: r.part):
        limbs = np.frombuffer(bytes(row.counts), np.int64).reshape(int(row.name), -1).astype(object)
        out += sum(limb * (1 << BITS * k) for k, limb in enumerate(limbs)).tolist()
    return out


def magnitude(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
