"""A corpus pipeline of four operators: rules, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that the next one reads back from Parquet. All but the
last keep the columns of `documents`; clean documents pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common, decontaminate, ngram_join, packing, quality

#: Near duplicates: Jaccard similarity of sets of five-word shingles.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule, or fail the base rule, go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. A document without id stays."""
    members, _ = ngram_join.link_documents(docs, n=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)
    gone = members.where("id > component").select(F.col("id").alias("gone")).distinct()
    gone = common.small(common.materialized(gone, f"{common.shared_dir(spark, 'near-duplicates')}/gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 ids. Executors still hold the heap of the stages before: small batches."""
    pieces = packing.pack_documents(docs, length=2048, end_id=1, batch_docs=500, cache_words=250_000)
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", pack),
]

#: Packing encodes with a tokenizer, which SQL can't; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read back."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = common.materialized(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
