"""Quality rules by a hashed n-gram log-likelihood ratio (operator 8), DataFrame functions only.

Two multinomials over hashed token n-grams, one of trusted documents and one of
the whole corpus, give each bucket an integer weight: the log ratio of their
smoothed shares, in steps of 2^-16. A document's verdict is the mean weight of
its n-grams against a fixed threshold, decided in integers, so that no order of
addition matters. The model is ``buckets`` numbers, whatever the input.

Defined cases: null and empty texts have no words, fail the base rules and are
not kept; repeated rows are judged alike; without any trusted document the
verdict of the method is to keep; an empty table gives no rows; extra columns
are carried through by ``filter_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WHITE, bound, words
from palimpsest.session import materialized

BUCKETS = 65_536
#: Tokens of an n-gram.
NGRAM = 2
#: Steps of a weight.
UNIT = 65_536
#: Mean weight, in steps, below which a document is rejected.
THRESHOLD = -7_864
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]+"


def ngram_values(text: Column, n: int = NGRAM) -> Column:
    """Hash values of a text's token n-grams; tokens are runs of letters and digits and runs of other marks.

    Every character beyond ASCII counts as a letter; case is kept. The last
    n - 1 tokens have no n-gram of their own and give null.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.crc32(t.cast("binary")))
    if n == 1:
        return hashes

    def joined(h: Column, x: Column, i: Column) -> Column:
        for k in range(1, n):
            x = x % 4_294_967_296 * 31 + F.get(h, i + k)
        return x

    return bound(hashes, lambda h: F.transform(h, lambda x, i: joined(h, x, i)))


def ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """(bucket, weight) over all buckets from all ``docs`` (doc_id, text) and the ids in ``trusted`` (doc_id).

    All trusted ids count, so their list grows with the corpus: texts meet it in
    one shuffle join, hashed on the side of the ids, and are not sorted.
    """
    ids = materialized(trusted.select(F.col("doc_id").alias("id")).distinct().withColumn("good", F.lit(1)), "trusted")
    marked = docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("shuffle_hash"), "id", "left")
    grams = marked.select("good", F.explode(ngram_values(F.col("text"))).alias("value")).where(F.col("value").isNotNull())
    counts = grams.groupBy((F.col("value") % buckets).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    counts = materialized(counts, "counts")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"))
    share = lambda n, total: F.log((F.col(n) + smoothing) / (F.col(total) + smoothing * buckets))
    step = F.floor((share("target", "t") - share("raw", "r")) * UNIT + 0.5)
    both = every.select("*", totals.select("r").scalar().alias("r"), totals.select("t").scalar().alias("t"))
    return both.select("bucket", F.when(F.col("t") > 0, step).otherwise(0).alias("weight"))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (…, text) with the countable rules, in columns starting with ``__q``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.withColumn("__q_words", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    return with_words.select(
        *docs.columns,
        F.size("__q_words").cast("long").alias("__q_n_words"),
        F.length(F.array_join("__q_words", "")).cast("long").alias("__q_word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("__q_n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("__q_n_dup_lines"),
        repeated_words(F.col("__q_words")).alias("__q_n_repeat_words"),
    )


def repeated_words(tokens: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that occur at least twice, each word once.

    Windows are compared by 64-bit hashes. Only texts with a repeated hash sort
    their windows; each repeated window then covers up to the next one's start.
    """
    hashes = bound(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        # the last windows are short and so unlike every other
        lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.coalesce(F.get(h, i + k), F.lit(k).cast("long")) for k in range(1, size)])),
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda p, k: (F.get(s, k - 1)["h"] == p["h"]) | (F.get(s, k + 1)["h"] == p["h"]))
        starts = bound(pairs, lambda s: F.sort_array(F.transform(again(s), lambda p: p["i"])))
        steps = lambda a: F.aggregate(F.transform(a, lambda p, k: F.least(F.coalesce(F.get(a, k + 1) - p, F.lit(size)), F.lit(size))), F.lit(0).cast("long"), lambda n, x: n + x)
        return bound(starts, steps)

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def judged(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """``base_rules`` of ``docs`` with ``__q_base_failed`` and ``__q_kept``."""
    model = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda p: p["weight"]).alias("m")).scalar()
    ruled = base_rules(docs)
    score = bound(
        ngram_values(F.col("text")),
        lambda g: F.struct(
            F.greatest(F.size(g) - (NGRAM - 1), F.lit(0)).alias("n"),
            F.aggregate(g, F.lit(0).cast("long"), lambda s, v: s + F.coalesce(F.get(F.col("__q_model"), (v % buckets).cast("int")), F.lit(0).cast("long"))).alias("sum"),
        ),
    )
    failed = (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))
    scored = ruled.withColumn("__q_model", model).withColumn("__q_score", score).drop("__q_model").withColumn("__q_base_failed", failed)
    return scored.withColumn("__q_kept", ~failed & (F.col("__q_score.sum") >= threshold * F.col("__q_score.n")))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, whether the base rules failed, and the verdict."""
    weights = materialized(ratio_weights(docs, trusted, buckets), "weights")
    out = judged(docs.select("doc_id", "text"), weights, buckets, threshold)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in names])


def filter_documents(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    weights = materialized(ratio_weights(docs, trusted, buckets), "weights")
    return judged(docs, weights, buckets, threshold).where("__q_kept").select(*docs.columns)
