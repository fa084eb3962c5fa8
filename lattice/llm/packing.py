"""Best-fit packing of tokenised documents into fixed-length sequences.

Texts are tokenised once; only lengths and checksums leave the tokenising tasks. Pieces are then dealt
at random, by their place in the table of pieces, so that repeated rows spread too, into shards of bounded size and each shard is packed by best fit, longest piece first: a
segment tree over remaining capacities finds the tightest open sequence in log2(length) steps. Packing
a shard alone costs at most a few part-filled sequences out of tens of thousands, and no shard grows
with the input, only their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.shared import Task, small_batches, table
from lattice.llm.text import blocks
from lattice.llm.tokens import Vocabulary, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open sequences by remaining capacity; ``place`` returns (sequence, offset) of the tightest one that takes a piece.

    Leaves of the tree are the capacities 0..size; a node tells whether a leaf below it has an open
    sequence. The tightest fit is the first such leaf at or right of the piece's length.
    """

    def __init__(self, size: int):
        self.size, self.width = size, 1 << size.bit_length()
        self.some = bytearray(2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = 0

    def _mark(self, capacity: int, value: int) -> None:
        node = capacity + self.width
        self.some[node] = value
        while node > 1:
            node >>= 1
            has = self.some[2 * node] | self.some[2 * node + 1]
            if self.some[node] == has:
                return
            self.some[node] = has

    def tightest(self, need: int) -> int:
        """The smallest capacity of an open sequence that is at least ``need``; -1 if there is none."""
        some, node = self.some, need + self.width
        if some[node]:
            return need
        while node > 1:
            if not node & 1 and some[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if some[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1

    def place(self, need: int) -> tuple[int, int]:
        capacity = self.tightest(need)
        if capacity < 0:
            bin_, capacity = self.count, self.size
            self.count += 1
        else:
            bin_ = self.open[capacity].pop()
            if not self.open[capacity]:
                self._mark(capacity, 0)
        left = capacity - need
        if left:
            self.open[left].append(bin_)
            if len(self.open[left]) == 1:
                self._mark(left, 1)
        return bin_, self.size - capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; lengths are 1 to size."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fit = BestFit(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = fit.place(int(lengths[i]))
    return bins, offsets


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, size: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    for batch in batches:
        ids_of = batch.column(0)
        for i, j, buf, offsets in blocks(batch):
            ids, at = encode(buf, offsets)
            rows, piece, start, length, crc = [], [], [], [], []
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                first = (b - a - 1) % size + 1  # a shorter piece comes first
                for n, s in enumerate([a, *range(a + first, b, size)]):
                    e = s + size if n else a + first
                    rows.append(k)
                    piece.append(n)
                    start.append(s - a)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
            own = ids_of.slice(i, j - i).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocabulary: Vocabulary, size: int = 2048) -> DataFrame:
    """One row per piece of each document's ids (end id included): doc_id, piece, start, length, ids_crc32.

    A document of more than ``size`` ids is cut into pieces of ``size``, the first of which may be
    shorter. Null and empty texts are the end id alone. Rows with the same or a null doc_id are packed
    like any others. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(Task(_cut, vocabulary=vocabulary, size=size), PIECES)


def _pack(shard: pa.Table, size: int) -> pa.Table:
    number = shard["shard"][0].as_py() << 32
    shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    bins, offsets = best_fit_decreasing(shard["length"].to_numpy(), size)
    return shard.drop_columns(["shard"]).append_column("sequence_id", pa.array(number + bins)).append_column("offset", pa.array(offsets))


def pack(docs: DataFrame, vocabulary: Vocabulary, size: int = 2048, per_shard: int = 100_000) -> DataFrame:
    """Packs all documents; pieces() with sequence_id and offset. Sequences of a full piece need no search.

    ``per_shard``: about how many pieces one task packs. No documents: no rows.
    """
    cut = table(pieces(docs, vocabulary, size), "pieces")
    shards = max(1, -(-cut.where(F.col("length") < size).count() // per_shard))
    part = cut.where(F.col("length") < size).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(shards)))
    packed = part.groupBy("shard").applyInArrow(lambda shard: _pack(shard, size), f"{PIECES}, sequence_id long, offset long")
    full = cut.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionAll(full)
