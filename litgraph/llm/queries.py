"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import LICENSES, LINE_RULES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import verdicts

    return verdicts(spark, table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import secrets

    return secrets(spark, table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import licenses

    return licenses(spark, table(spark, sf_dir, "documents"))


def op5_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(spark, table(spark, sf_dir, "documents"))


def op7_site_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_tree import extract

    return extract(spark, table(spark, sf_dir, "pages"))


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_line_rules": op2_line_rules,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_simhash_leaks": op5_simhash_leaks,
    "op6_hash_tree": op6_hash_tree,
    "op7_site_trees": op7_site_trees,
    "op8_prob_minhash": op8_prob_minhash,
    "op9_discriminant": op9_discriminant,
    "op10_best_fit": op10_best_fit,
}
ORACLES: dict[str, str] = {"op2_line_rules": LINE_RULES, "op4_licenses": LICENSES}
