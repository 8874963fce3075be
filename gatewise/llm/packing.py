"""Best-fit-decreasing packing of tokenised documents into sequences.

Best fit decreasing looks only at lengths, so the packing of any corpus is
fixed by how many pieces there are of each length (at most ``size`` numbers).
Those counts go to the driver; a segment tree over the remaining capacities
finds the tightest open bin for a length in logarithmic time, for all bins of
that capacity at once.  The result is a short table of placements (length,
range of ranks, first bin, pieces per bin, offset).  The pieces themselves
never leave the executors: each gets its rank among the pieces of its length
(task-local number plus the counts of earlier tasks) and looks its bin up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.bpe import encoder
from gatewise.llm.store import hold

SIZE = 1024
END = np.array([2], dtype="<u4").tobytes()

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class CapacityTree:
    """Segment tree over capacities 0..size: which of them have open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest capacity >= need that has an open bin."""
        at = self.leaves + need
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first_rank, pieces, first_bin, per_bin, offset) of best fit decreasing.

    A piece goes to the open bin with the least room that holds it.  After it
    that bin is tighter than every other bin that still holds the length, so
    pieces of one length fill a bin before the next one is touched; bins of
    equal capacity are handled as ranges.
    """
    tree, ranges, bins, out = CapacityTree(size), {}, 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n:
            ranges.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted((k for k in counts if k > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, per = size, size // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = ranges[capacity].pop()
                tree.add(capacity, -n)
                per = capacity // length
            used = min(n, -(-left // per))
            full = min(used, left // per)
            here = min(left, used * per)
            out.append((length, rank, here, first, per, size - capacity))
            put(capacity - per * length, first, full)
            if used > full:
                put(capacity - (here - full * per) * length, first + full, 1)
            put(capacity, first + used, n - used)
            rank, left = rank + here, left - here
    return out


def pieces_of(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """Token pieces of every row: length and checksum, numbered within task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = encoder(path), [0] * (size + 1)
        part = TaskContext.get().partitionId()
        for b in batches:
            docs_, pieces, starts, lengths, sums, nth = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text or "") + END
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n % size or size) if k == 0 else size
                    docs_.append(doc)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    nth.append(seen[length])
                    seen[length] += 1
                    at, k = at + length, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array([part] * len(docs_), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated rows and null doc_ids included; a
    null text is an empty one (its end id alone).  A document of more than
    ``size`` ids is cut so that only its first piece may be shorter.  Other
    columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    pieces = hold(pieces_of(docs, size, path))
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    placed = sorted(best_fit(counts, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = each.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    table = np.array(placed, dtype=np.int64).reshape(-1, 6)
    # sorted by (length, first_rank); ranks stay below 2^44, lengths below 2^19
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(length) else table[:0]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
