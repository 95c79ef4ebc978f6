"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, so that neighbours differ in few bits. A
node of the index covers a run of them: it holds the bits that all of the run share (a pattern under a
mask), and its children hold only the bits that they share beyond those. A search goes down with the
difference accumulated so far, and a node whose accumulated difference exceeds the limit prunes its whole run.

Of two fingerprints within k bits of each other, one of k + 1 blocks of bits is equal. So the fingerprints are
sorted k + 1 times, turned so that each block comes first once; those with an equal first block then stand
together, and partners are looked for among them only. Each order is dealt into ranges. The ranges' shared
patterns are the upper part of the index, small enough to broadcast: with it, a fingerprint finds the later
ranges that its block reaches into, which are few, and is sent there. Each range builds and searches the
lower part of the index on its own. With two bits a fingerprint has at most 2080 partners, whatever a group's
size, and only a spanning forest of each batch's links leaves a task.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, documents, id_text, share, slices, text_bytes, written
from plumbline.llm.components import connected

FAN = 4                       # children of a node
FRONTIER = 1 << 19            # nodes that a search expands at once
RANGE = 16_384                # fingerprints of a range, more only where MOST_RANGES would be exceeded
MOST_RANGES = 65_536          # bounds the broadcast upper part: 16 bytes each and its inner nodes
SHINGLES = 1 << 16            # hashes of a text that are turned into bits at once
FULL = np.uint64((1 << 64) - 1)


def fingerprint(data: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0. Lower-cases A-Z."""
    words = data.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate(([0], ends[:len(words) - size])).tolist(), (ends[size - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for first in range(0, len(starts), SHINGLES):
        pieces = zip(starts[first:first + SHINGLES], ends[first:first + SHINGLES])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in pieces], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def gray_rank(column: str) -> Column:
    """The rank of a 64-bit code in the Gray code, as a long in the order of unsigned ranks."""
    rank = F.col(column)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """Patterns in Gray order with their masks, and above them the bits that runs of them share."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray):
        levels = [(patterns, masks)]
        while len(levels[-1][0]) > 1:
            patterns, masks = levels[-1]
            firsts = np.arange(0, len(patterns), FAN)
            differ = np.bitwise_or.reduceat(patterns ^ np.repeat(patterns[firsts], FAN)[:len(patterns)], firsts)
            shared = np.bitwise_and.reduceat(masks, firsts) & ~differ
            levels.append((patterns[firsts] & shared, shared))
        self.levels = []                               # what a node has beyond its parent
        for k, (patterns, masks) in enumerate(levels):
            above = np.repeat(levels[k + 1][1], FAN)[:len(masks)] if k + 1 < len(levels) else np.uint64(0)
            own = masks & ~above
            self.levels.append((patterns & own, own))

    def search(self, codes: np.ndarray, limit: int, after: np.ndarray | None = None, equal: int = 0):
        """Yields (code numbers, leaf numbers) of pairs within ``limit`` bits of each other on the leaf's
        mask, and the same in the bits ``equal``. ``after``: for each code the leaf from which on it looks for partners."""
        top = len(self.levels) - 1
        if not len(self.levels[0][0]):
            return
        everyone = np.arange(len(codes))
        open_nodes = [(top, everyone, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8))]
        while open_nodes:
            level, code, node, differ = open_nodes.pop()
            if len(code) > FRONTIER:
                half = len(code) // 2
                open_nodes += [(level, code[half:], node[half:], differ[half:]), (level, code[:half], node[:half], differ[:half])]
                continue
            pattern, own = self.levels[level]
            apart = (codes[code] ^ pattern[node]) & own[node]
            differ = differ + np.bitwise_count(apart)
            near = (differ <= limit) & (apart & np.uint64(equal) == 0)
            if after is not None:
                near &= (node + 1) * FAN ** level > after[code]
            code, node, differ = code[near], node[near], differ[near]
            if not len(code):
                continue
            if not level:
                yield code, node
                continue
            children = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = children < len(self.levels[level - 1][0])
            open_nodes.append((level - 1, np.repeat(code, FAN)[there], children[there], np.repeat(differ, FAN)[there]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components as the links (a, b), one for each node but the roots."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def turns(limit: int) -> list[tuple[int, int]]:
    """(bits to turn left by, mask of the block that then comes first) for each of ``limit`` + 1 blocks."""
    edges = [64 * k // (limit + 1) for k in range(limit + 2)]
    return [(a, ((1 << (b - a)) - 1) << (64 - b + a)) for a, b in zip(edges[:-1], edges[1:])]


def links(distinct: DataFrame, limit: int = 2, range_rows: int = RANGE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs at
    ``limit`` or fewer differing bits."""
    spark, around = distinct.sparkSession, turns(limit)
    ranges = min(max(-(-len(around) * distinct.count() // range_rows), 1), MOST_RANGES)
    fp = F.col("fp")
    every = F.array(*[F.struct(F.lit(k).alias("turn"), (F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp).alias("code"))
                      for k, (by, _) in enumerate(around)])
    placed = distinct.select(F.explode(every).alias("t")).select("t.turn", "t.code", gray_rank("t.code").alias("rank"))
    placed = written(placed.repartitionByRange(ranges, "turn", "rank").select(
        "turn", "code", "rank", F.spark_partition_id().alias("part")), "gray-order")
    roots = placed.groupBy("turn", "part").agg(F.bit_and("code").alias("all"), F.bit_or("code").alias("any")).orderBy("turn", "part").collect()
    upper = []                                          # per turn: the index of its ranges, and their numbers
    for turn in range(len(around)):
        own = [r for r in roots if r["turn"] == turn]
        shared = np.array([r["all"] for r in own], np.int64).view(np.uint64)
        some = np.array([r["any"] for r in own], np.int64).view(np.uint64)
        upper.append((Tree(shared, shared | ~some), np.array([r["part"] for r in own], np.int32)))
    upper = share(spark, upper)

    def routed(batches):
        for batch in slices(batches, 4096):
            turns_of, code, rank, part = (batch.column(i).to_numpy() for i in range(4))
            yield {"turn": turns_of, "part": part, "kind": np.zeros(len(part), np.int32), "rank": rank, "code": code}
            for turn in np.unique(turns_of).tolist():
                tree, parts = upper.value[turn]
                at = np.flatnonzero(turns_of == turn)
                for own, root in tree.search(code[at].view(np.uint64), limit, np.searchsorted(parts, part[at]) + 1, around[turn][1]):
                    own = at[own]
                    yield {"turn": turns_of[own], "part": parts[root], "kind": np.ones(len(own), np.int32), "rank": rank[own], "code": code[own]}

    def searched(batches):
        current, held, tree, codes = None, [], None, None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)) + 1
            for turn, part, kind, code in zip(*(np.split(c, edges) for c in columns)):
                if not len(code):
                    continue
                of = int(turn[0]), int(part[0])
                if held and (of != current or kind[0]):        # what is held is a whole range
                    tree, codes = built(held)
                    yield from within(current[0], tree, codes)
                    held = []
                current = of
                if kind[0]:
                    yield from found(of[0], tree, codes, code.view(np.uint64), None)
                else:
                    held.append(code.view(np.uint64))
        if held:
            yield from within(current[0], *built(held))

    def built(held):
        codes = np.concatenate(held)
        return Tree(codes, np.full(len(codes), FULL)), codes

    def within(turn, tree, codes):
        for first in range(0, len(codes), 8192):
            own = codes[first:first + 8192]
            yield from found(turn, tree, codes, own, np.arange(first + 1, first + 1 + len(own)))

    def found(turn, tree, codes, own, after):
        by, equal = around[turn]
        for code, leaf in tree.search(own, limit, after, equal):
            a, b = forest(own[code], codes[leaf])
            if by:
                a, b = ((c >> np.uint64(by)) | (c << np.uint64(64 - by)) for c in (a, b))
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    sent = arrow_map(placed.select("turn", "code", "rank", "part"), routed, "turn int, part int, kind int, rank long, code long")
    dealt = sent.repartition("turn", "part").sortWithinPartitions("turn", "part", "kind", "rank").select("turn", "part", "kind", "code")
    return arrow_map(dealt, searched, "a long, b long").distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2,
                    range_rows: int = RANGE) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``df``; ``fingerprint`` as 16 hex digits.

    Null, empty and blank texts have fingerprint zero, linked like any other. Rows with equal fingerprints
    are linked, so copies need no pairs. A component is named by its smallest id. A row with a null id
    has a null component, but its fingerprint links others; rows that share an id are judged by their own texts.
    """
    def digested(batches):
        for batch in slices(batches):
            codes = [fingerprint(data, width) for data in text_bytes(batch.column(1))]
            yield {"id": batch.column(0), "fp": np.array(codes, np.uint64).view(np.int64)}

    docs = id_text(df, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    rows = written(arrow_map(docs, digested, "id long, fp long"), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    edges = written(links(distinct.select("fp"), limit, range_rows), "links")
    named = distinct.withColumnRenamed("rep", "component_id")
    if not edges.isEmpty():
        joined = written(connected(edges), "components").withColumnRenamed("node", "fp").join(distinct, "fp")
        least = joined.groupBy("component").agg(F.min("rep").alias("least"))
        named = distinct.join(joined.select("fp", "component").join(least, "component").select("fp", "least"), "fp", "left").select(
            "fp", F.coalesce("least", "rep").alias("component_id"))
    named = written(named, "names")
    return rows.join(named, "fp", "left").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir):
    """op13: fingerprints and components of all documents."""
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
