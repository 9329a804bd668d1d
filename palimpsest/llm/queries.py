"""Registered queries of this folder: one operator each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bound_collocations, bracket_resampling, count_packing, cover_dedup, fourier_quality, length_histogram, likelihood_rules, matrix_packing, part_enum, secret_ownership, skip_chain, threshold_search, tree_mixing
from palimpsest.llm.common import table, words
from palimpsest.llm.sql import ORACLE  # noqa: F401

#: The operator-10 queries' tree; the domain of a source is one of four by its checksum.
LEVELS = ["domain", "lang", "source"]


def op1_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain.find(table(spark, sf_dir, "documents"))


def op2_count_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fourier_quality.score(table(spark, sf_dir, "documents"), labels)


def op4_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.join_components(table(spark, sf_dir, "documents"))


def op6_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_packing.id_matrices(table(spark, sf_dir, "documents"))


def op7_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood_rules.judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.token_counts(table(spark, sf_dir, "documents"))


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    return docs.withColumn(name, F.concat(F.lit("domain"), F.crc32(F.col("source").cast("binary")) % 4))


def op10_tree_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = with_domain(docs).select("doc_id", "domain", "lang", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    return tree_mixing.mix(counted, LEVELS, "n_tokens").withColumnRenamed("__mix_epoch", "epoch")


def op11_bracket_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bracket_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` name no owner: a source stands for the owner, its part in one language for a repository."""
    return secret_ownership.find(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"))


def op13_bound_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_skip_chain, op2_count_packing, op3_fourier_quality, op4_threshold_search, op5_part_enum, op6_packed_matrices, op7_cover_dedup, op8_likelihood_rules, op9_token_counts, op10_tree_mixing,
                                  op11_bracket_resampling, op12_secret_ownership, op13_bound_collocations)}
