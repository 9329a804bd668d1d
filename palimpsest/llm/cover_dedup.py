"""Removal of repeated byte strings, one suffix bucket at a time (operator 7).

The suffixes that matter start a string of ``length`` bytes. A cover sample of
positions is fixed first: in every string of ``length`` bytes the block of
``GRAM`` bytes with the least hash, the leftmost of equals. As with a difference
cover, two equal strings have a sampled position at the same distance from their
starts; unlike residues, positions chosen by content need only about 1.2 % of all
positions, and all copies of a passage agree on them. Every start belongs to
exactly one sampled position, which so owns a run of starts.

Sampled positions are ranked by the whole stretch that their run covers. Equal
ranks resolve long ties at once: where a stretch occurs twice, all its starts
repeat. A sampled block that occurs once resolves its starts as unique. What is
left are the edges of repeats: their stretches, and one copy of each repeated
one, go to the bucket of their sampled block, and a task sorts the suffixes of one bucket at a time by the hash of
their first ``length`` bytes. Buckets of more than ``HOT`` different stretches are
spread over all tasks by those hashes instead. Blocks that a sample of the documents
shows to be frequent are dealt out by (block, stretch) rather than by block.

Strings are compared by 64-bit polynomial hashes with random byte values.

Defined cases: null and empty texts have no bytes and nothing removed; repeated
rows are elsewhere to each other, so both are removed; strings never cross
documents; texts of any size are read in slices of ``SLICE`` bytes; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialized

GRAM = 32
HOT = 20_000
SLICE = 1 << 17
#: One of so many documents is looked at for frequent blocks; at most so many are named.
LOOK, MOST_FREQUENT = 64, 1000

#: A run is repeated (0), open (1), open in a hot bucket (2), or repeated and its stretch's entry in a bucket (3, hot 4).
SURE, HOT_STATES = (0, 3, 4), (2, 4)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _prefix(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])


def _hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the strings [lo, hi), independent of their places."""
    return _mix((prefix[hi] - prefix[lo]) * _power(_INVERSE, len(prefix))[lo])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def sampled_runs(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(block hash, stretch hash, sampled position, first start, last start) in concatenated texts that end at ``ends``."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = _prefix(raw)
    places = np.arange(n - GRAM + 1)
    blocks = _hashes(prefix, places, places + GRAM)
    bits = np.uint64(max(n, 1 << 23).bit_length())  # the same for all slices, or hashes would tie differently
    least = _least(((blocks >> bits) << bits) | places.astype(np.uint64), length - GRAM + 1)
    owner = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    fits = ends - begins >= length
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begins[fits], 1)
    np.add.at(steps, ends[fits] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps)[: n - length + 1])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    owner = owner[starts]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    at, lo, hi = owner[first], starts[first], starts[last]
    shape = _mix(((at - lo) * 65_536 + (at - hi)).astype(np.uint64) + np.uint64(1))
    return blocks[at].view(np.int64), _mix(_hashes(prefix, lo, hi + length) ^ shape).view(np.int64), at, lo, hi


def _slices(texts, length: int):
    """(text number, offset in it, bytes) parts in groups of about ``SLICE`` bytes; parts of a text overlap by length - 1."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), SLICE):
            part = text[offset : offset + SLICE + length - 1]
            if size and size + len(part) > SLICE + length:
                yield held
                held, size = [], 0
            held.append((k, offset, part))
            size += len(part)
    if held:
        yield held


def _sample(docs: DataFrame, length: int) -> DataFrame:
    """One row per sampled position of ``docs`` (kid, h, raw)."""

    def take(batches):
        for batch in batches:
            for parts in _slices((t.as_py() for t in batch.column("raw")), length):
                ends = np.cumsum([len(p[2]) for p in parts])
                block, stretch, at, lo, hi = sampled_runs(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends, length)
                part = np.searchsorted(ends, lo, side="right")
                shift = (np.array([p[1] for p in parts]) - np.concatenate([[0], ends[:-1]]))[part]
                rows = pa.array(np.array([p[0] for p in parts])[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kid").take(rows), batch.column("h").take(rows), pa.array(block), pa.array(stretch), pa.array((at + shift).astype(np.int32)), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32))],
                    names=["kid", "h", "block", "stretch", "at", "lo", "hi"],
                )

    return docs.select("kid", "h", "raw").mapInArrow(take, "kid long, h long, block long, stretch long, at int, lo int, hi int")


def _unions(spans: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching unions of [lo, hi) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def cut(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, and what is kept of ``text`` without ``spans``."""
    runs, kept, end = _unions(spans), [], 0
    for lo, hi in runs.tolist():
        kept.append(text[end:lo])
        end = hi
    return int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join([*kept, text[end:]])


def _written(rows, kinds: list[pa.DataType], names: list[str], weigh):
    """Record batches of ``rows``, closed whenever their texts reach some slices' size."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row)
        size += 100 + weigh(row)
        if size > 16 * SLICE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _columns(structs: pa.ListScalar, n: int) -> np.ndarray:
    """A list of structs of ``n`` numbers as rows."""
    if not structs.is_valid or not len(structs.values):
        return np.zeros((0, n), np.int64)
    return np.stack([np.array(structs.values.field(k)) for k in range(n)], 1).astype(np.int64)


OUTPUT = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()))


def _verdict(doc_id, text: bytes, spans: np.ndarray, with_text: bool) -> tuple:
    removed, runs, kept = cut(text, spans)
    return doc_id, len(text), removed, runs, kept if with_text else None, hashlib.sha256(kept).hexdigest()


def _settled(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Verdicts where nothing is open; else the text with its repeated and open runs."""
    names = [n for n, _ in OUTPUT] + ["kid", "h", "raw", "repeated", "opened"]
    kinds = [k for _, k in OUTPUT] + [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def settled(batch):
        for doc_id, kid, h, raw, runs in zip(*(batch.column(c) for c in ("doc_id", "kid", "h", "raw", "runs"))):
            text = raw.as_py()
            found = _columns(runs, 4)
            sure, opened = found[np.isin(found[:, 3], SURE)][:, 1:3], found[found[:, 3] > 0]
            spans = sure + np.array([0, length])
            if len(opened):
                yield doc_id.as_py(), len(text), 0, 0, None, None, kid.as_py(), h.as_py(), text, _unions(spans).ravel().tolist(), opened.ravel().tolist()
            else:
                yield *_verdict(doc_id.as_py(), text, spans, with_text), kid.as_py(), h.as_py(), None, None, None

    def settle(batches):
        for batch in batches:
            yield from _written(settled(batch), kinds, names, lambda row: len(row[8] or b"") + len(row[4] or b""))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, kid long, h long, raw binary, repeated array<int>, opened array<int>"
    return rows.mapInArrow(settle, schema)


def _stretches(opened: DataFrame, length: int) -> DataFrame:
    """The bytes of every open run under its sampled block: (block, hot, kid, h, lo, bytes)."""

    def stretches(batch):
        for kid, h, raw, runs in zip(*(batch.column(c) for c in ("kid", "h", "raw", "opened"))):
            text, kid, h = raw.as_py(), kid.as_py(), h.as_py()
            for at, lo, hi, state in np.array(runs.values, np.int64).reshape(-1, 4).tolist():
                block = int.from_bytes(hashlib.blake2b(text[at : at + GRAM], digest_size=8).digest(), "little", signed=True)
                yield block, state in HOT_STATES, kid, h, lo, text[lo : hi + length]

    def emit(batches):
        for batch in batches:
            yield from _written(stretches(batch), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["block", "hot", "kid", "h", "lo", "bytes"], lambda row: len(row[5]))

    return opened.mapInArrow(emit, "block long, hot boolean, kid long, h long, lo int, bytes binary")


def _windows(stretches: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every string of ``length`` bytes, and the number of its stretch."""
    sizes = np.array([len(s) for s in stretches])
    counts = sizes - length + 1
    starts = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
    prefix = _prefix(np.frombuffer(b"".join(stretches), np.uint8))
    return _hashes(prefix, starts, starts + length), np.repeat(np.arange(len(stretches)), counts)


def _sorted_buckets(stretches: DataFrame, length: int) -> DataFrame:
    """Repeated starts (kid, h, lo, hi) of stretches, bucket by bucket."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch | None:
        hashes, number = _windows([r[4] for r in rows], length)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        if not len(at):
            return None
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (number[at[1:]] != number[at[:-1]])]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        begin = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(rows)))[:-1]])
        owner = number[at[first]]
        base = np.array([r[3] for r in rows])[owner] - begin[owner]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[1] for r in rows])[owner]), pa.array(np.array([r[2] for r in rows])[owner]), pa.array((base + at[first]).astype(np.int32)), pa.array((base + at[last]).astype(np.int32))],
            names=["kid", "h", "lo", "hi"],
        )

    def by_bucket(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "kid", "h", "lo", "bytes"))):
                if size > SLICE // 2 and row[0] != held[-1][0]:
                    if (found := resolve(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (found := resolve(held)) is not None:
            yield found

    placed = stretches.where("not hot").repartition("block").sortWithinPartitions("block")
    return placed.mapInArrow(by_bucket, "kid long, h long, lo int, hi int")


def _spread_buckets(stretches: DataFrame, length: int) -> DataFrame:
    """As ``_sorted_buckets`` for hot buckets: every start is dealt by the hash of its string."""

    def emit(batches):
        for batch in batches:
            if batch.num_rows:
                hashes, number = _windows(batch.column("bytes").to_pylist(), length)
                begin = np.concatenate([[0], np.cumsum(np.bincount(number))[:-1]])
                lo = np.array(batch.column("lo"))[number] + np.arange(len(number)) - begin[number]
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("kid").take(rows), batch.column("h").take(rows), pa.array(lo.astype(np.int32))], names=["string", "kid", "h", "lo"])

    starts = stretches.where("hot").mapInArrow(emit, "string long, kid long, h long, lo int")
    again = starts.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return starts.join(again, "string", "left_semi").select("kid", "h", "lo", F.col("lo").alias("hi"))


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sizes, removed runs, the kept bytes and their hash.

    ``length`` is at least ``GRAM`` + 1. Without ``with_text`` the kept bytes are null.
    """
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("kid"), F.xxhash64("text").alias("h"), raw.alias("raw"))
    sample = _sample(base, length)
    few = _sample(base.where(F.pmod(F.xxhash64("kid", "h"), F.lit(LOOK)) == 0), length).groupBy("block").agg(F.count("*").alias("n"))
    frequent = few.where(F.col("n") >= 8).orderBy(F.desc("n")).limit(MOST_FREQUENT).select("block", F.lit(True).alias("frequent"))
    dealt = (
        sample.join(F.broadcast(materialized(frequent, "frequent")), "block", "left")
        .withColumn("salt", F.when(F.col("frequent"), F.pmod(F.col("stretch"), F.lit(1024)).cast("int")).otherwise(-1))
        .drop("frequent").repartition("block", "salt")
    )
    in_stretch, in_block = Window.partitionBy("block", "salt", "stretch"), Window.partitionBy("block", "salt")
    ranked = (
        dealt.withColumn("repeated", F.count("*").over(in_stretch) > 1)
        .withColumn("entry", F.row_number().over(in_stretch.orderBy("kid", "h", "lo")) == 1)
        .withColumn("entries", F.sum(F.col("entry").cast("long")).over(in_block))
    )
    ranked = materialized(ranked.where("repeated OR entries > 1 OR salt >= 0").drop("stretch"), "ranked")
    busy = ranked.where("salt >= 0 AND entry").groupBy("block").agg(F.count("*").alias("many"))  # at most MOST_FREQUENT rows
    counted = ranked.join(F.broadcast(busy), "block", "left").withColumn("entries", F.when(F.col("salt") >= 0, F.col("many")).otherwise(F.col("entries")))
    is_entry = F.col("entry") & (F.col("entries") > 1)
    state = F.when(~is_entry, 0).otherwise(F.when(F.col("repeated"), 3).otherwise(1) + F.when(F.col("entries") > hot, 1).otherwise(0))
    runs = (
        counted.where("repeated OR entries > 1")
        .groupBy("kid", "h").agg(F.collect_list(F.struct("at", "lo", "hi", state.alias("state"))).alias("runs"))
    )
    settled = materialized(_settled(base.join(runs, ["kid", "h"], "left"), length, with_text), "settled")
    opened = settled.where(F.col("raw").isNotNull())
    stretches = _stretches(opened, length)
    marks = _sorted_buckets(stretches, length).unionByName(_spread_buckets(stretches, length))
    found = marks.groupBy("kid", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def finished(batch):
        for doc_id, raw, sure, more in zip(*(batch.column(c) for c in ("doc_id", "raw", "repeated", "found"))):
            spans = np.concatenate([np.array(sure.values, np.int64).reshape(-1, 2), _columns(more, 2) + np.array([0, length])])
            yield _verdict(doc_id.as_py(), raw.as_py(), spans, with_text)

    def finish(batches):
        for batch in batches:
            yield from _written(finished(batch), [k for _, k in OUTPUT], [n for n, _ in OUTPUT], lambda row: len(row[4] or b""))

    names = [n for n, _ in OUTPUT]
    late = opened.join(found, ["kid", "h"], "left").select("doc_id", "raw", "repeated", "found").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return settled.where(F.col("raw").isNull()).select(*names).unionByName(late)
