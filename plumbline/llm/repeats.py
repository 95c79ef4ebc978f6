"""Suffix-array dedup: remove every byte of a string of ``LENGTH`` bytes that also starts earlier.

1. Every text is sampled at anchors: positions whose ``GRAM``-byte hash is the least of some window of hashes
   (winnowing), so that every string of ``LENGTH`` bytes contains an anchor's gram, the same one in each copy.
   Around an anchor lies its context, all strings of ``LENGTH`` bytes that contain its gram.
2. Anchors are dealt by the gram's hash. A gram that occurs once cannot be repeated. An anchor whose
   whole context occurred earlier repeats all of it. What is left are the first occurrences of the
   different contexts of a gram; only they need their bytes.
3. These contexts, aligned at the gram, become short strings of integers: columns between two places where some
   contexts of the gram part are one piece, and a piece's number stands for its bytes. One suffix array over
   the strings of many grams (linear grouping, ``suffixarray``) and its common prefixes then give, for every
   stretch of pieces, the classes of equal strings; all but the earliest of a class are repeats.
4. The repeated stretches of a text are united and cut out.

A gram with more different contexts than ``hot`` is taken by its windows instead: a row for each string,
grouped by a 128-bit hash with partial aggregation, so that no task holds the gram's contexts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, discard, documents, id_text, release, share, slices, text_bytes, written
from plumbline.llm.suffixarray import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM                 # bytes of context before the anchor, and after its gram
CONTEXT = REACH + LENGTH
CELLS = 1 << 17
HOT = 200_000
PAD = 0xFF                            # never a byte of UTF-8
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def run_hashes(data: np.ndarray, width: int, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive bytes, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, size, total = data.astype(np.uint64) * np.uint64(seed) + MIX, 1, None
    covered, left = 0, width
    while left:
        if left & 1:
            part = power[covered:]
            if total is None:
                total = part
            else:
                total = (total[:len(part)] ^ (total[:len(part)] >> TURN)) * np.uint64(seed) + part
            covered += size
        left >>= 1
        if left:
            power = (power[:-size] ^ (power[:-size] >> TURN)) * np.uint64(seed | 2) + power[size:]
            size *= 2
    total = total[:len(data) - width + 1] * MIX
    return total ^ (total >> TURN)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a text of ``LENGTH`` bytes or more."""
    hashes, span = run_hashes(data, GRAM), REACH + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), hashes[:0]

    def slid(values, best):
        size = 1
        while size * 2 <= span:
            values = best(values[:-size], values[size:])
            size *= 2
        return best(values[:len(values) - (span - size)], values[span - size:]) if size < span else values

    least = slid(hashes, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(slid(np.concatenate([edge, least, edge]), np.maximum) == hashes)
    return chosen, hashes[chosen]


def contexts(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The context bytes of anchors, one row each; beyond the text's ends ``PAD``."""
    padded = np.concatenate([np.full(REACH, PAD, np.uint8), data, np.full(LENGTH, PAD, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[positions]


def row_hashes(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(np.uint64)
    mixed = np.full(len(rows), MIX)
    for i in range(words.shape[1]):
        mixed = (mixed ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> TURN
    return mixed


def extents(positions: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(positions, REACH), np.minimum(size - positions, LENGTH)


def sampled(docs: DataFrame) -> DataFrame:
    """One row per anchor: gram hash, context hash, id, position, and the context's extent before and after.

    Among the rows read together, repeats are told at once and marked ``again``: an anchor whose context
    occurs earlier, and, as one row for the whole text with a null gram, a copy of a text with a smaller id.
    """
    def task(batches):
        for batch in batches:
            texts: dict[bytes, list[int]] = {}
            for number, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if number is not None and len(data) >= LENGTH:
                    texts.setdefault(data, []).append(number)
            parts, copies = [], []
            for data, numbers in texts.items():
                number = min(numbers)
                copies += [(other, len(data)) for other in set(numbers) - {number}]
                data = np.frombuffer(data, np.uint8)
                positions, grams = anchors(data)
                before, after = extents(positions, len(data))
                parts.append((grams.astype(np.int64), row_hashes(contexts(data, positions)).astype(np.int64),
                              np.full(len(positions), number, np.int64), positions, before, after))
            if copies:
                none, zeros = [None] * len(copies), [0] * len(copies)
                yield {"gram": none, "context": none, "id": [c[0] for c in copies], "position": zeros, "before": zeros,
                       "after": [c[1] for c in copies], "again": [True] * len(copies)}
            if not parts:
                continue
            gram, context, number, position, before, after = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((position, number, context, gram))
            new = np.concatenate(([True], (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1])))
            again = np.empty(len(order), bool)
            again[order] = ~new
            yield {"gram": gram, "context": context, "id": number, "position": position, "before": before, "after": after,
                   "again": again}

    return arrow_map(docs, task, "gram long, context long, id long, position int, before int, after int, again boolean")


def marked(anchored: DataFrame) -> DataFrame:
    """(id, position, gram, start, end): spans of repeated contexts, with a null gram, and the contexts
    whose bytes must be compared, with a null span. A gram's rows are bounded: hot ones are not here."""
    def task(batches):
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            edges = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            cut = int(edges[-1]) if len(edges) else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield from judged([r[:cut] for r in rows])
        if held is not None and len(held[0]):
            yield from judged(held)

    def judged(rows):
        gram, context, number, position, before, after = rows
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        new_context = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
        several = np.bincount(np.cumsum(new_gram) - 1, weights=new_context) > 1
        wanted = new_context & several[np.cumsum(new_gram) - 1]
        first = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]
        repeat = ~new_context & ((number != number[first]) | (position != position[first])) & (before + after >= LENGTH)
        for chosen, compare in ((wanted, True), (repeat, False)):
            at = np.flatnonzero(chosen)
            if len(at):
                none = [None] * len(at)
                yield {"id": number[at], "position": position[at], "gram": gram[at] if compare else none,
                       "start": none if compare else position[at] - before[at],
                       "end": none if compare else position[at] + after[at]}

    dealt = anchored.select("gram", "context", "id", "position", "before", "after").repartition("gram").sortWithinPartitions(
        "gram", "context", "id", "position")
    return arrow_map(dealt, task, "id long, position int, gram long, start int, end int")


def by_document(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the rows of each id as arrays."""
    grouped = rows.groupBy("id").agg(*(F.collect_list(c).alias(c) for c in columns))
    return docs.join(grouped, "id", "left")


def context_rows(joined: DataFrame) -> DataFrame:
    """(gram, id, position, bytes) for the positions that ``marked`` asks for."""
    def task(batches):
        for batch in slices(batches):
            for number, data, positions, grams in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)),
                                                      batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not positions:
                    continue
                rows = contexts(np.frombuffer(data, np.uint8), np.array(positions, np.int64))
                yield {"gram": grams, "id": [number] * len(rows), "position": positions, "bytes": [r.tobytes() for r in rows]}

    return arrow_map(joined, task, "gram long, id long, position int, bytes binary")


def compared(rows: DataFrame, chunk: int = 20_000) -> DataFrame:
    """(id, start, end) of the repeated strings among contexts that were dealt by gram."""
    def task(batches):
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for column, values in zip(held, (batch.column(i).to_pylist() for i in range(4))):
                column += values
            last = len(held[0])
            if last < chunk:
                continue
            while last and held[0][last - 1] == held[0][-1]:
                last -= 1
            if last:
                yield from found([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held[0]:
            yield from found(held)

    def found(columns):
        number, start, end = repeated_strings(*columns)
        if len(number):
            yield {"id": number, "start": start, "end": end}

    dealt = rows.repartition("gram").sortWithinPartitions("gram", "id", "position")
    return arrow_map(dealt, task, "id long, start int, end int")


def pieces(gram: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the contexts of a gram part, as sorted (group, column) pairs: column c begins a new piece. And how
    far each context agrees with some other one before the anchor and from the anchor on.

    Outward from the anchor, contexts part at the common prefixes of neighbours in sorted order, for the
    bytes behind it and, reversed, for those before it.
    """
    group = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    key = np.ascontiguousarray(group.astype(">u4")).view(np.uint8).reshape(-1, 4)
    cuts, reach = [], []
    for part, place in ((matrix[:, REACH:], lambda c: REACH + c), (matrix[:, REACH - 1::-1], lambda c: REACH - c)):
        keyed = np.ascontiguousarray(np.concatenate([key, part], axis=1))
        order = np.argsort(keyed.view(f"S{keyed.shape[1]}").ravel(), kind="stable")
        ranked = keyed[order]
        differ = ranked[1:] != ranked[:-1]
        alike = ~differ[:, :4].any(axis=1) & differ[:, 4:].any(axis=1)
        where = differ[alike, 4:].argmax(axis=1)
        cuts.append(group[order][1:][alike] * (CONTEXT + 1) + place(where))
        agree = np.where(differ[:, :4].any(axis=1), 0, part.shape[1])
        agree[alike] = where
        agree = np.concatenate(([0], agree, [0]))
        own = np.empty(len(order), np.int64)
        own[order] = np.maximum(agree[:-1], agree[1:])
        reach.append(own)
    groups = np.arange(group[-1] + 1) * (CONTEXT + 1)
    cuts = np.unique(np.concatenate([*cuts, groups, groups + REACH, groups + CONTEXT]))
    return group, cuts, reach[1], reach[0]


def repeated_strings(grams: list[int], numbers: list[int], positions: list[int], rows: list[bytes]):
    """Ids, starts and ends of the strings of ``LENGTH`` bytes that have an earlier equal, among whole groups of
    contexts ordered by gram, id and position."""
    gram, number, position = np.array(grams, np.int64), np.array(numbers, np.int64), np.array(positions, np.int64)
    matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), CONTEXT)
    _, _, left, right = pieces(gram, matrix)
    keep = left + right >= LENGTH                             # others share no whole string
    if not keep.any():
        return number[:0], position[:0], position[:0]
    gram, number, position, matrix = gram[keep], number[keep], position[keep], matrix[keep]
    group, cuts, left, right = pieces(gram, matrix)
    cut_group, column = cuts // (CONTEXT + 1), cuts % (CONTEXT + 1)
    first_cut = np.searchsorted(cut_group, np.arange(group[-1] + 2))
    # the string of integers: the pieces of every context as far as it agrees with another one, one
    # context after the other
    begins = np.searchsorted(cuts, group * (CONTEXT + 1) + REACH - left)
    size = np.searchsorted(cuts, group * (CONTEXT + 1) + REACH + right) - begins
    offset = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(gram)), size)
    at = begins[row] + np.arange(offset[-1]) - offset[row]
    skipped = begins - first_cut[group]
    begin, end = column[at], column[at + 1]
    running = np.zeros((len(gram), CONTEXT + 1), np.uint64)   # polynomial hashes of the columns before
    factor = np.uint64(0xD6E8FEB86659FD93)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(CONTEXT, factor))), dtype=np.uint64)
    for c in range(CONTEXT):
        running[:, c + 1] = running[:, c] * factor + matrix[:, c].astype(np.uint64) + np.uint64(1)
    content = running[row, end] - running[row, begin] * powers[end - begin]
    content ^= (at.astype(np.uint64) + np.uint64(1)) * MIX    # a piece's place belongs to its number
    # later places get smaller numbers, which was measured to be faster than other orders
    by_place = np.lexsort((content, -at))
    new = np.concatenate(([True], (at[by_place][1:] != at[by_place][:-1]) | (content[by_place][1:] != content[by_place][:-1])))
    text = np.empty(len(by_place), np.int64)
    text[by_place] = np.cumsum(new)
    text = text.tolist()
    order = np.array(suffix_array(text), np.int64)
    # what is asked: per group, stretches of pieces (a, b) and the strings that lie in them
    bounds, columns = first_cut.tolist(), column.tolist()
    asked = [stretches(columns[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    counts = np.array([len(s) for s in asked])
    table = np.array([s for g in asked for s in g], np.int64).reshape(-1, 4)      # a, pieces, least d, most d
    first_ask = np.concatenate(([0], np.cumsum(counts)))
    q_row = np.repeat(np.arange(len(gram)), counts[group])
    q = first_ask[group[q_row]] + np.arange(len(q_row)) - np.repeat(np.cumsum(counts[group]) - counts[group], counts[group])
    inside = matrix != PAD
    before, after = inside[:, :REACH].sum(axis=1), inside[:, REACH:].sum(axis=1)
    # the string must lie in the text, and in what the context shares with another one
    low = np.maximum(table[q, 2], LENGTH - np.minimum(after, right)[q_row])
    high = np.minimum(table[q, 3], np.minimum(before, left)[q_row])
    valid = low <= high
    q_row, q, low, high = q_row[valid], q[valid], low[valid], high[valid]
    suffix, need = offset[q_row] + table[q, 0] - skipped[q_row], table[q, 1]
    if not len(q):
        return number[:0], position[:0], position[:0]
    shared = common_prefixes(text, order, int(need.max()))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    earliest = np.zeros(len(q), np.int64)
    owner = row[order]                                        # contexts are in order of occurrence within a gram
    for length in np.unique(need):
        of = np.flatnonzero(need == length)
        starts = np.flatnonzero(np.concatenate(([True], shared[1:] < length)))
        smallest = np.minimum.reduceat(owner, starts)
        earliest[of] = smallest[np.searchsorted(starts, rank[suffix[of]], "right") - 1]
    first = earliest
    again = (first != q_row) & ((number[first] != number[q_row]) | (position[first] != position[q_row]))
    q_row, low, high = q_row[again], low[again], high[again]
    if not len(q_row):
        return number[:0], position[:0], position[:0]
    # strings around one anchor overlap: of each context, one span
    edges = np.flatnonzero(np.concatenate(([True], q_row[1:] != q_row[:-1])))
    at = q_row[edges]
    start, end = position[at] - np.maximum.reduceat(high, edges), position[at] - np.minimum.reduceat(low, edges) + LENGTH
    return number[at], start.astype(np.int32), end.astype(np.int32)


def stretches(columns: list[int]) -> list[tuple[int, int, int, int]]:
    """(first piece, pieces, least d, most d) for the strings that begin d bytes before the anchor, d from 0 to
    ``REACH``: strings that begin and end in the same pieces are asked for together."""
    bounds = sorted({0, REACH + 1, *(v for c in columns for v in (REACH - c + 1, CONTEXT - c) if 0 < v <= REACH)})
    out = []
    for least, beyond in zip(bounds, bounds[1:]):
        a = bisect_right(columns, REACH - least) - 1
        out.append((a, bisect_left(columns, REACH - least + LENGTH) - a, least, beyond - 1))
    return out


def hot_windows(docs: DataFrame, cells: list[int]) -> DataFrame:
    """(id, start, end) of repeated strings around the anchors of hot cells, from a row per string."""
    hot = np.zeros(CELLS, bool)
    hot[cells] = True
    shared = share(docs.sparkSession, hot)

    def task(batches):
        hot = shared.value
        for batch in slices(batches):
            for number, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                data = np.frombuffer(data, np.uint8)
                if number is None or len(data) < LENGTH:
                    continue
                positions, grams = anchors(data)
                positions = positions[hot[cell_of(grams)]]
                if not len(positions):
                    continue
                starts = np.unique(positions[:, None] - np.arange(REACH + 1))
                starts = starts[(starts >= 0) & (starts + LENGTH <= len(data))]
                yield {"w1": run_hashes(data, LENGTH)[starts].astype(np.int64),
                       "w2": run_hashes(data, LENGTH, 0xBF58476D1CE4E5B9)[starts].astype(np.int64),
                       "id": [number] * len(starts), "start": starts.astype(np.int32)}

    rows = arrow_map(docs, task, "w1 long, w2 long, id long, start int")
    first = rows.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["w1", "w2"]).where("struct(id, start) > first").select(
        "id", "start", (F.col("start") + LENGTH).alias("end"))


def cell_of(grams: np.ndarray) -> np.ndarray:
    return grams.astype(np.int64) % CELLS


def removals(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """(id, start, end): repeated stretches of the texts (id, text), in bytes; they may overlap."""
    anchored = written(sampled(docs), "anchors")
    cell = F.pmod("gram", F.lit(CELLS))
    loads = anchored.where("not again").groupBy(cell.alias("cell")).count().where(F.col("count") > hot)
    cells = [r.cell for r in loads.collect()]                 # at most CELLS numbers
    usual = anchored.where("not again")
    at_once = anchored.where(f"again and before + after >= {LENGTH}").select(
        "id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("gram"),
        (F.col("position") - F.col("before")).alias("start"), (F.col("position") + F.col("after")).alias("end"))
    marks = written(marked(usual.where(~cell.isin(cells)) if cells else usual).union(at_once), "marks")
    discard(anchored)
    wanted = marks.where("gram is not null")
    rows = context_rows(by_document(docs, wanted, "position", "gram").select("id", "text", "position", "gram"))
    spans = written(compared(rows), "repeats")
    out = marks.where("gram is null").select("id", "start", "end").union(spans)
    return out.union(hot_windows(docs, cells)) if cells else out


def united(starts, ends) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts or (), ends or ())):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept): per row the bytes of the text, the removed spans (start, end, start, end, ...)
    and the remaining bytes.

    Strings are judged on the input: a string repeated earlier goes even if its earlier copy goes as well.
    Null and empty texts, and texts shorter than ``LENGTH``, keep everything, and so do rows with a null id.
    Rows that repeat both id and text are one occurrence.
    """
    docs = id_text(df, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    spans = removals(docs, hot=hot)
    release(df.sparkSession)

    def task(batches):
        for batch in slices(batches):
            out = {"id": batch.column(0), "n_bytes": [], "spans": [], "kept": []}
            for data, starts, ends in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                removed, kept, at = united(starts, ends), [], 0
                for start, end in removed:
                    kept.append(data[at:start])
                    at = end
                out["n_bytes"].append(len(data))
                out["spans"].append([edge for span in removed for edge in span])
                out["kept"].append(b"".join([*kept, data[at:]]))
            yield out

    joined = by_document(docs, spans, "start", "end").select("id", "text", "start", "end")
    return arrow_map(joined, task, "id long, n_bytes long, spans array<long>, kept binary")


def query(spark, sf_dir):
    """op2: repeated strings over all documents."""
    found = without_repeats(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

