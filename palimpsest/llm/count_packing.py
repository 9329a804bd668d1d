"""Best-fit packing planned over the length histogram (operator 2).

The plan sees only how many pieces have each length: best-fit decreasing walks
the lengths, whole ranges of equal bins at a time, and writes down which ranks
of which length go to which sequences at which offset. Pieces then take their
slots by an equi-join on (length, rank within length). The driver holds at most
``capacity`` counts and the plan, whose size depends on ``capacity`` alone.

Defined cases: a null text is an empty one; an empty text still has its end id
and is one piece of length 1; repeated rows are packed once each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import encoded, encoder
from palimpsest.session import materialized

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks that one row of the plan's expansion covers.
CHUNK = 16_384


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): every text's ids and ``end_id``, cut only if longer than ``capacity``."""

    def cut(batches):
        tokens = encoder(vocabulary)
        for batch in batches:
            for first, ids, ends in encoded(batch.column("text"), tokens, end_id):
                lengths = np.diff(ends, prepend=0)
                parts = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(ends)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                at = (ends - lengths)[doc] + start
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                sums = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(at.tolist(), (at + length).tolist())]
                columns = [batch.column("doc_id").take(pa.array(first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset) rows.

    Bins of one remaining room form ranges of sequences; a length fills the
    tightest room first, each bin with as many pieces as fit. Each length adds at
    most one new range and splits at most two, so ranges stay below three times
    ``capacity`` and rows below their number times the pieces a bin can hold.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    filled, plan, sequences = 0, [], 0  # filled: bit r is set while room[r] has ranges
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            tight = filled >> length
            if tight:
                r = length + (tight & -tight).bit_length() - 1
                first, bins = room[r].pop()
                if not room[r]:
                    filled &= ~(1 << r)
            else:
                r, first, bins = capacity, sequences, -(-left // (capacity // length))
                sequences += bins
            each = r // length
            full, part = min(bins, left // each), 0
            if full < bins:
                part = left - full * each
            for lo, n, k in ((first, full, each), (first + full, 1 if part else 0, part)):
                if n:
                    for j in range(k):
                        plan.append((length, rank, n, lo, capacity - r + j * length))
                        rank += n
                    left -= n * k
                    room[r - k * length].append((lo, n))
                    filled |= 1 << (r - k * length)
            used = full + (part > 0)
            if used < bins:
                room[r].append((first + used, bins - used))
                filled |= 1 << r
    return plan


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """``parts`` (as ``pieces`` gives them) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = materialized(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_counts(counts, capacity) or [(1, 0, 0, 0, 0)]
    plan = spark.createDataFrame(rows, "length long, first long, ranks long, sequence long, offset long")
    slots = (
        plan.withColumn("chunk", F.explode(F.expr(f"sequence(0L, greatest(ranks - 1, 0) div {CHUNK})")))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "length", "first", "chunk")  # a small plan, yet a row for every piece
        .withColumn("step", F.explode(F.expr(f"filter(sequence(chunk * {CHUNK}, chunk * {CHUNK} + {CHUNK - 1}), x -> x < ranks)")))
        .select("length", (F.col("first") + F.col("step")).alias("rank"), (F.col("sequence") + F.col("step")).alias("sequence_id"), "offset")
    )
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("ranks_before") + F.col("inside") - 1)
    )
    return ranked.join(slots, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)
