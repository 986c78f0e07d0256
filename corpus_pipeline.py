"""From raw documents to packed training sequences: five stages over the operators of litgraph.llm.

Each stage takes all that its predecessor kept, and its decisions take effect; all but the last return the columns of
documents, with every other column that the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litgraph.llm import decontaminate, near_dup, packing, quality, secrets_scan
from litgraph.llm.common import made, release, shared_dir, table
from litgraph.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return secrets_scan.mask(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage kept for itself is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        at = made()
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        release(spark, at)
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
