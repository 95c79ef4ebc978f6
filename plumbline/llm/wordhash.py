"""Word hashes of whole text columns, computed on the column's bytes.

A word's hash adds its bytes, each times a 64-bit number for its place in the word. Words are never made
into Python objects; only a word beyond ``LONG`` bytes is hashed on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LONG = 1 << 14
PIECE = 1 << 15               # bytes hashed at once


def _scattered(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTES = np.arange(256)
SPACE = np.isin(_BYTES, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
VALUE = np.where(SPACE, 0, np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 33, _BYTES + 1)).astype(np.uint64)   # A-Z as a-z
PLACE = _scattered((np.arange(LONG + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (between ASCII white space; A-Z lowered) of a text column, and the number of
    the first word of each text and of what follows the last. Null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)               # before this byte a text begins
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG)
    first = 0
    while first < len(starts):
        if ends[first] - starts[first] > LONG:
            hashes[first] = xxhash.xxh3_64_intdigest(bytes(data[starts[first]:ends[first]]).lower())
            first += 1
            continue
        last = max(first + 1, np.searchsorted(starts, starts[first] + PIECE))
        stop = np.searchsorted(long, first)
        if stop < len(long):
            last = min(last, long[stop])
        at, to = starts[first:last], ends[last - 1]
        place = np.arange(to - at[0]) - np.repeat(at - at[0], np.diff(np.append(at, to)))
        parts = VALUE[data[at[0]:to]] * PLACE[np.minimum(place, LONG)]
        hashes[first:last] = np.add.reduceat(parts, at - at[0])
        first = last
    return _scattered(hashes), np.searchsorted(starts, offsets)
