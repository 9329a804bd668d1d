"""Exact length histogram with suffix sums (operator 9).

Documents are aggregated to (encoded length, count) before anything is moved;
suffix sums over the histogram, bucket by bucket with carried totals, then
answer every context limit at once; ``at_limits`` and ``at_quantiles`` read the
answers for given limits and shares off them.

Defined cases: null and empty texts have length 0; repeated rows count once
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import encoded, encoder
from palimpsest.session import materialized

#: Lengths that one task sums; limits of any size stay spread over tasks.
BUCKET = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row (length) for each row of ``docs`` (text)."""

    def measure(batches):
        tokens = encoder(vocabulary)
        for batch in batches:
            for _, _, ends in encoded(batch.column("text"), tokens):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends, prepend=0))], names=["length"])

    return docs.select(F.col("text").cast("string")).mapInArrow(measure, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs) of ``lengths`` (length)."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def context_totals(hist: DataFrame) -> DataFrame:
    """For each occurring length, as a context limit: what lies at or above it and what truncation keeps.

    docs_at_least and tokens_at_least are suffix sums; truncated_tokens is the
    sum of min(length, limit); quantile is the share of documents that fit.
    """
    hist = materialized(hist.withColumn("bucket", F.floor(F.col("length") / BUCKET)), "histogram")  # read twice, encoded once
    totals = hist.groupBy("bucket").agg(F.sum("n_docs").alias("bucket_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("bucket_tokens"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    carried = totals.select(
        "bucket",
        F.coalesce(F.sum("bucket_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bucket_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("bucket_docs").over(whole).alias("all_docs"),
        F.sum("bucket_tokens").over(whole).alias("all_tokens"),
    )
    here = Window.partitionBy("bucket").orderBy(F.desc("length"))
    docs_at_least = F.col("later_docs") + F.sum("n_docs").over(here)
    tokens_at_least = F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("length")).over(here)
    out = hist.join(carried, "bucket").select("length", "n_docs", "all_docs", "all_tokens", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"))
    return out.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(totals: DataFrame, limits: list[int]) -> DataFrame:
    """``context_totals`` for any context ``limits``, one row each, answered from the first occurring length at or above it.

    Beyond the longest document nothing lies above and nothing is cut; without documents quantile is null.
    """
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))]))
    every = totals.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0)).alias("all_tokens"))
    above = totals.select("*", asked.alias("limit")).where("length >= limit").groupBy("limit").agg(F.min_by(F.struct("length", "n_docs", "docs_at_least", "tokens_at_least", "truncated_tokens"), "length").alias("row"))
    row = lambda name: F.coalesce(F.col(f"row.{name}"), F.lit(0))
    longer = row("docs_at_least") - F.when(F.col("row.length") == F.col("limit"), F.col("row.n_docs")).otherwise(0)
    return every.select("*", asked.alias("limit")).join(above, "limit", "left").select(
        "limit", row("docs_at_least").alias("docs_at_least"), row("tokens_at_least").alias("tokens_at_least"),
        F.coalesce(F.expr("row.truncated_tokens - (row.length - limit) * row.docs_at_least"), F.col("all_tokens")).alias("truncated_tokens"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def at_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """For each of ``shares``, the least occurring length that this share of the documents fits in; null if none is."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(shares))]))
    return totals.agg(F.max("quantile").alias("__most")).select(asked.alias("share")).join(
        totals.select("*", asked.alias("share")).where("quantile >= share").groupBy("share").agg(F.min("length").alias("length")), "share", "left")


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    return context_totals(histogram(encoded_lengths(docs, vocabulary)))
