"""Packed token-id matrices by best-fit decreasing with a segment tree (operator 6).

Each task packs the documents of its own input partition, a bounded block of
tokens at a time, so nothing is shuffled and a task holds one block. A segment
tree over remaining room finds the tightest bin in log(capacity) steps. Overlong
documents are cut without loss. One output row is one row of the id matrix, of
fixed width, with cumulative segment lengths, position resets and the document
and piece of every segment, from which ``unpack`` restores every document.

Defined cases: null and empty texts hold the end id alone; repeated rows are
packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import encoded, encoder

MATRIX = (
    "shard int, block int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, doc_pieces array<int>"
)


class RoomTree:
    """Bins by remaining room; ``take(n)`` gives a bin with the least room of at least ``n``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        node = room + self.leaves
        while node:
            self.held[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        node = need + self.leaves
        if not self.held[node]:
            while node > 1 and (node & 1 or not self.held[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.held[2 * node] else 2 * node + 1
        room = node - self.leaves
        name = self.bins[room].pop()
        while node:
            self.held[node] -= 1
            node >>= 1
        return room, name


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin, best-fit decreasing."""
    tree, bins = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        room, name = found
        bins[name].append(item)
        tree.put(room - lengths[item], name)
    return bins


def id_matrices(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, pad_id: int = 0, block_tokens: int = 2_000_000) -> DataFrame:
    """Rows of packed id matrices (little-endian unsigned 32-bit ids) of ``docs`` (doc_id, text)."""

    def rows(shard, block, items):
        for n, held in enumerate(best_fit([len(i[2]) for i in items], capacity)):
            line = np.full(capacity, pad_id, "<u4")
            ends = np.cumsum([0] + [len(items[i][2]) for i in held])
            for i, lo, hi in zip(held, ends, ends[1:]):
                line[lo:hi] = items[i][2]
            yield shard, block, n, int(ends[-1]), line.tobytes(), ends.tolist(), ends[:-1].tolist(), [items[i][0] for i in held], [items[i][1] for i in held]

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = [c.split()[0] for c in MATRIX.split(", ")]

    def pack(batches):
        tokens, shard, block, items, held = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0

        def written():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows(shard, block, items)), kinds)], names=names)

        for batch in batches:
            names_here = batch.column("doc_id").to_pylist()
            for first, ids, ends in encoded(batch.column("text"), tokens, end_id):
                lo = 0
                for n, hi in enumerate(ends.tolist()):
                    for k, start in enumerate(range(lo, hi, capacity)):
                        items.append((names_here[first + n], k, ids[start : min(start + capacity, hi)]))
                        held += len(items[-1][2])
                        if held >= block_tokens:
                            yield written()
                            block, items, held = block + 1, [], 0
                    lo = hi
        if items:
            yield written()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, MATRIX)


def unpack(matrix: DataFrame) -> DataFrame:
    """The pieces back from the matrix: (doc_id, piece, ids binary), without padding."""
    parts = matrix.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_pieces")).alias("k", "segment"))
    lo, hi = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return parts.select(F.col("segment.doc_ids").alias("doc_id"), F.col("segment.doc_pieces").alias("piece"), F.substring(F.col("input_ids"), 4 * lo + 1, 4 * (hi - lo)).alias("ids"))
