"""Best-fit-decreasing packing of token sequences.

Best fit places documents from the longest on, each into the open sequence with the least room that still takes it. What
that does depends only on how many pieces there are of each length, so:

1. the texts are encoded once, cut into pieces of at most ``room`` tokens, and one small row per piece is written;
2. the number of pieces of each length, ``room`` numbers at most, goes to the driver. There best fit runs over groups of
   sequences that were treated alike, with a segment tree over remaining capacities that finds the least one that is at
   least a length in logarithmic steps. Pieces of one length fill a group together;
3. the result is a table of ranges: the pieces of a length with ranks from .. to go to these sequences, at this place. A
   piece's rank among those of its length is its rank inside its task's part plus the counts of the parts before it.

No task and not the driver sees all pieces, and a length that a third of all pieces have is an ordinary row of counts.

Cases: NULL and empty texts are one piece of the closing id; longer texts are cut into full pieces and a shorter last one;
repeated rows are packed each; an empty table gives no rows; a NULL doc_id is carried; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.llm.bpe import encoded_blocks, public_vocabulary
from splitclock.llm.common import column, numbers, table, written

ROOM = 4096
CLOSE = 1


class CapacityTree:
    """Which capacities 0 .. size-1 are present, with the least present one from a bound on in logarithmic steps."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size:
            self.leaves *= 2
        self.present = [False] * (2 * self.leaves)

    def put(self, capacity: int, present: bool) -> None:
        k = capacity + self.leaves
        self.present[k] = present
        k //= 2
        while k:
            self.present[k] = self.present[2 * k] or self.present[2 * k + 1]
            k //= 2

    def least_from(self, bound: int) -> int:
        """The least present capacity >= bound, or -1."""
        k = bound + self.leaves
        if k >= 2 * self.leaves:
            return -1
        if self.present[k]:
            return bound
        while k > 1:
            if k % 2 == 0 and self.present[k + 1]:
                k += 1
                break
            k //= 2
        else:
            return -1
        while k < self.leaves:
            k = 2 * k if self.present[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over ``counts`` pieces of each length 1 .. room.

    Returns ranges (length, first rank, end rank, first sequence, per sequence, offset): the pieces with these ranks go
    ``per sequence`` at a time into consecutive sequences, the first of each at ``offset``.
    """
    tree = CapacityTree(room + 1)
    groups: dict[int, list[tuple[int, int]]] = {}  # capacity left -> (first sequence, sequences)

    def add(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            if capacity not in groups:
                groups[capacity] = []
                tree.put(capacity, True)
            groups[capacity].append((first, n))

    ranges, sequences = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.least_from(length)
            if capacity < 0:
                capacity, first, n = room, sequences, -(-left // (room // length))
                sequences += n
            else:
                first, n = groups[capacity].pop()
                if not groups[capacity]:
                    del groups[capacity]
                    tree.put(capacity, False)
            per = capacity // length
            full = min(n, left // per)
            offset = room - capacity
            if full:
                ranges.append((length, rank, rank + full * per, first, per, offset))
                add(capacity - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # one sequence gets the last of them; the others of the group stay
                ranges.append((length, rank, rank + left, first + full, per, offset))
                add(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(capacity, first + full, n - full)
    return ranges


def pieces(docs: DataFrame, path: str, room: int = ROOM, close: int = CLOSE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): the pieces of every text. rank counts the pieces of a length
    in the part, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        closing = int(close).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in encoded_blocks(batch, path):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at : at + 4 * room]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own)))
            if not rows:
                continue
            row, piece, start, length, crc = np.array(rows, np.int64).T
            order = np.argsort(length, kind="stable")
            values, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first - seen[values], n)
            seen[values] += n
            doc = column(batch, "doc_id").cast(pa.int64()).take(pa.array(row))
            yield pa.record_batch([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int64)), pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(docs: DataFrame, path: str, room: int = ROOM, close: int = CLOSE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each text goes."""
    cut = written(pieces(docs, path, room, close), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = np.array(best_fit(counts, room), np.int64).reshape(-1, 6)
    # Ranges by length and rank; a piece's range is the last that begins at or before it.
    found = found[np.lexsort((found[:, 1], found[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, _, sequences, pers, places = found.T
        begins = np.append(np.searchsorted(lengths, np.arange(room + 2)), len(lengths))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = numbers(batch, "length"), numbers(batch, "rank") + numbers(batch, "before")
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = begins[x] + np.searchsorted(firsts[begins[x] : begins[x + 1]], rank[own], side="right") - 1
            k = rank - firsts[at]
            sequence, offset = sequences[at] + k // pers[at], places[at] + k % pers[at] * length
            yield pa.record_batch([*[column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = cut.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return joined.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_vocabulary())
