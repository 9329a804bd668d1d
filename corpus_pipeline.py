"""The corpus pipeline: quality rules, near copies, personal data, source mixture, packing.

Every stage takes the documents its predecessor kept and returns documents; the
last one returns their places in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import count_packing, likelihood_rules, part_enum, skip_chain, tree_mixing
from palimpsest.llm.common import table, words
from palimpsest.llm.queries import LEVELS, trusted_ids, with_domain
from palimpsest.session import materialized

#: Near copies of the pipeline: five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the likelihood ratio reject."""
    return likelihood_rules.filter_documents(docs, trusted_ids(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near copies."""
    return part_enum.keep_first(docs, SHINGLE, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = skip_chain.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, drawn evenly over the tree of domains, languages and sources, for two epochs at most."""
    counted = with_domain(docs, "__domain").withColumn("__tokens", F.size(words(F.col("text"))).cast("long"))
    return tree_mixing.mix(counted, ["__domain", *LEVELS[1:]], "__tokens").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token piece of the documents lies in sequences of 2048 tokens."""
    return count_packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("source mixture", source_mixture),
    ("best-fit packing", packed),
]

#: Tokenizing and message passing have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
