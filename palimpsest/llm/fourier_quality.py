"""Quality scores by random Fourier features, ridge regression and isotonic calibration (operator 3).

Every text becomes a short vector of document statistics, once. Cosines of seeded
random projections of the standardised vector approximate a Gaussian kernel. The
labelled rows' normal equations are summed inside partitions and added up; their
solution scores documents, and pool-adjacent-violators over binned scores of a
labelled part the equations never saw turns scores into probabilities.

Only the text enters a score. Rows whose crc32(doc_id as text) mod 5 is 0 are
held out of everything that is learned; remainder 1 calibrates, 2 to 4 fit. About
``FIT_ROWS`` labelled rows at most are used, chosen by hash of doc_id.

Defined cases: null texts count as empty and are scored like empty ones; a
document labelled twice has its larger label; null labels are no labels; repeated
rows are scored alike; without labels every score is 0.5; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialized

FIT_ROWS = 200_000
FEATURES = 256
RIDGE = 1.0
WIDTH = 1.5
SEED = 11
#: Partitions whose normal equations are added on the driver.
PARTS = 16
BINS = 4096

# Byte classes. Each string's bytes form one class; bytes of no string are "other", from 0x80 "beyond ASCII".
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:?", "!", "#*$%&|<>", "'\"()[]{}-")


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.int64)
    table[128:] = len(_CLASSES) + 1
    for k, letters in enumerate(_CLASSES):
        table[[ord(c) for c in letters]] = k
    return table


_TABLE = _byte_classes()
N_STATS = len(_CLASSES) + 2 + 12


def statistics(text: str) -> np.ndarray:
    """The statistics vector of one text; zeros for an empty one."""
    raw = np.frombuffer(text.encode(errors="replace"), np.uint8)
    out = np.zeros(N_STATS)
    if not len(raw):
        return out
    bytes_ = np.bincount(raw, minlength=256)
    shares = bytes_[bytes_ > 0] / len(raw)
    classes = np.bincount(_TABLE, weights=bytes_, minlength=len(_CLASSES) + 2) / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    out[: len(classes)] = classes
    out[len(classes) :] = (
        -(shares * np.log(shares)).sum(),
        math.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        math.log1p(sizes.max()),
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
    )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, part, stats) of ``docs`` (doc_id, text); part is crc32 of the id's text mod 5."""

    def measure(batches):
        for batch in batches:
            stats = [statistics(t.as_py() or "") for t in batch.column("text")]
            flat = pa.array(np.concatenate(stats).astype(np.float32) if stats else np.zeros(0, np.float32))
            offsets = pa.array(np.arange(len(stats) + 1) * N_STATS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "part", "stats"])

    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return docs.select(F.col("doc_id").cast("long"), part.cast("int").alias("part"), F.col("text").cast("string")).mapInArrow(measure, "doc_id long, part int, stats array<float>")


def _features(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8)
    waves = math.sqrt(2 / FEATURES) * np.cos(z @ model["directions"] + model["phases"])
    return np.concatenate([np.ones((len(z), 1)), z / 8, waves], 1)


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over partitions of ``add(stats, labels)``, an array of ``size`` numbers."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("stats").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, N_STATS)
                total += add(x, np.array(batch.column("label").to_numpy(zero_copy_only=False), float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("stats", F.col("label").cast("double")).coalesce(PARTS).mapInArrow(partial, "part binary").collect()
    return sum((np.frombuffer(r.part) for r in parts), np.zeros(size))


def _isotonic(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, label sum, count) rows by score: block starts and values."""
    blocks: list[list[float]] = []
    for score, ones, n in sorted(bins):
        blocks.append([score, ones, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, ones, n = blocks.pop()
            blocks[-1][1] += ones
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    return _features(x, model) @ model["weights"]


def calibrated(raw: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities, rising with the raw score: its block's value, with a sliver to keep the order inside blocks."""
    k = np.clip(np.searchsorted(model["starts"], raw, side="right") - 1, 0, None)
    return np.clip(0.998 * model["values"][k] + 0.002 / (1 + np.exp(-4 * (np.clip(raw, -10, 10) - 0.5))), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """The model from ``stats`` (doc_id, part, stats) and ``labels`` (doc_id, label); None without labels."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = stats.where("part <> 0").join(known, "doc_id")
    total = known.count()
    share = min(1_000_000, math.ceil(1_000_000 * fit_rows / max(total, 1)))
    rows = materialized(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).repartition(PARTS, "doc_id"), "labelled")
    fitting, calibrating = rows.where("part <> 1"), rows.where("part = 1")

    sums = _summed(fitting, 2 * N_STATS + 1, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    n = sums[-1]
    if not n:
        return None
    mean = sums[:N_STATS] / n
    spread = np.sqrt(np.maximum(sums[N_STATS:-1] / n - mean**2, 0))
    draw = np.random.default_rng(SEED)
    model = {
        "mean": mean, "spread": np.where(spread > 1e-6, spread, 1.0),
        "directions": draw.normal(0, 1 / (WIDTH * math.sqrt(N_STATS)), (N_STATS, FEATURES)), "phases": draw.uniform(0, 2 * math.pi, FEATURES),
    }
    size = 1 + N_STATS + FEATURES

    def equations(x, y):
        z = _features(x, model)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(fitting, size * size + size, equations)
    model["weights"] = np.linalg.solve(sums[: size * size].reshape(size, size) + RIDGE * np.eye(size), sums[size * size :])

    def binned(x, y):
        k = np.clip(((raw_scores(x, model) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, y, BINS), np.bincount(k, minlength=BINS)])

    sums = _summed(calibrating, 2 * BINS, binned)
    if not sums[BINS:].any():
        sums = _summed(fitting, 2 * BINS, binned)
    bins = [(2 * k / BINS - 0.5, sums[k], sums[BINS + k]) for k in np.flatnonzero(sums[BINS:])]
    model["starts"], model["values"] = _isotonic(bins)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text) from ``labels`` (doc_id, label)."""
    stats = materialized(document_statistics(docs), "statistics")
    model = fit(stats, labels, fit_rows)

    def judge(batches):
        for batch in batches:
            value = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                x = np.array(batch.column("stats").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, N_STATS)
                value = calibrated(raw_scores(x, model), model)
            held = pa.array(np.array(batch.column("part").to_numpy(zero_copy_only=False)) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
