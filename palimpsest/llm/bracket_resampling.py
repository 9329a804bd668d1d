"""Importance resampling towards a target with a bracketed cutoff (operator 11).

Features are hashed runs of words; each bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus. Gains form one array, of
``buckets`` numbers whatever the input, and a document's weight is a sum of its
entries. Gumbel noise keyed by the document turns the k highest scores into a
weighted draw without replacement.

The cutoff is bracketed by a quantile sketch. Exact counts above and inside the
bracket show whether it holds the k-th score; if not, the bracket is widened, at
last to all scores. Only the rows inside are sorted to find the cutoff; rows
above are sorted for their ranks alone, rows below never.

Defined cases: null and empty texts have no features and weight 0; a null doc_id
draws its noise as the empty string; repeated rows are drawn one by one, equal
ones in any order; without a target text every feature counts against; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialized

BUCKETS = 10_000
#: A worker forgets its features beyond this many and starts afresh.
MOST_FEATURES = 1_000_000
#: Rows that one task ranks.
RANK_ROWS = 200_000
#: Share of the rows on either side of the sketched cutoff, and how fast it widens.
MARGIN, WIDER = 0.004, 4

# Word characters are ASCII digits and letters and every byte beyond ASCII; A-Z become a-z, all else a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))


class _Buckets(dict):
    """Bucket of each feature met so far."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_FEATURES:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value


def feature_buckets(text: str | None, known: _Buckets, longest: int = 1) -> tuple[int, np.ndarray]:
    """(words, bucket of each feature) of a whole text."""
    words = (text or "").encode().translate(_FOLD).split()
    features = list(words)
    for n in range(2, longest + 1):
        features += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(bucket, n) over all ``texts`` (text); every task adds up before anything is moved."""

    def count(batches):
        known, held = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                held += np.bincount(feature_buckets(text.as_py(), known, longest)[1], minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(held[found])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from two ``bucket_counts``; ``2 * buckets`` numbers reach the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, counts in ((s, corpus), (t, target)):
        for row in counts.collect():
            held[row.bucket] = row.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Keyed Gumbel noise in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text)."""

    def score(batches):
        known = _Buckets(len(gain))
        for batch in batches:
            rows = [(n, len(b), int(gain[b].sum())) for n, b in (feature_buckets(t.as_py(), known, longest) for t in batch.column("text"))]
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(numbers[:, k]) for k in range(3)]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its rank from 1 by ``order``: range partitions sorted one by one, with carried sizes.

    The ranges are written once with their numbers, so a lost task cannot deal
    them differently; only one size per range meets in one place.
    """
    rows = df.count()
    dealt = materialized(df.repartitionByRange(max(1, -(-rows // RANK_ROWS)), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__row", inside).join(sizes, "__range").select(*df.columns, (F.col("__before") + F.col("__row")).alias(out))


def bracket(scores: DataFrame, percent: int, margin: float = MARGIN) -> tuple[int, int, int, int] | None:
    """(wanted, lowest, highest, above): the score of rank ``wanted`` of ``scores`` (score) lies from lowest to highest, and ``above`` rows lie higher.

    None if no row is wanted. Sketches and counts are single rows.
    """
    while True:
        shares = [max(0.0, 1 - percent / 100 - margin), min(1.0, 1 - percent / 100 + margin)]
        row = scores.agg(F.count("*").alias("n"), F.percentile_approx("score", shares, 10_000).alias("edges"), F.min("score").alias("least"), F.max("score").alias("most")).first()
        wanted = row.n * percent // 100
        if not wanted:
            return None
        low = row.least if shares[0] == 0 else row.edges[0]
        high = row.most if shares[1] == 1 else row.edges[1]
        exact = scores.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if exact.above <= wanted <= exact.reached:
            return wanted, low, high, exact.above
        margin *= WIDER


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, margin: float = MARGIN) -> DataFrame:
    """Every document with its weight, its score and, if drawn, its rank.

    Drawn are the ``percent`` hundredths of the ``docs`` (doc_id, text) of at
    least ``least_words`` words with the highest scores, towards ``target`` (text).
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialized(scored, "scores")
    able = F.col("n_words") >= least_words
    names = ["doc_id", "n_features", "weight", "score"]
    found = bracket(scored.where(able).select("score"), percent, margin)
    if found is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    wanted, low, high, above = found
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    over = ranked(scored.where(able & (F.col("score") > high)).select(*names), order, "rank")
    inside = ranked(scored.where(able & F.col("score").between(low, high)).select(*names), order, "place")
    inside = inside.select(*names, F.when(F.col("place") <= wanted - above, F.col("place") + above).alias("rank"))
    below = scored.where(~able | (F.col("score") < low)).select(*names, F.lit(None).cast("long").alias("rank"))
    return over.unionByName(inside).unionByName(below)
