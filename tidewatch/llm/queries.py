"""The queries of these operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, line_dedup, mixing, quality_rules, rule_ensemble, secret_scan, sharding, simhash, spelling, substring_dedup, token_files, urls
from .sql import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("row_key")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_table(spark, sf_dir, "documents"), sharding.tree_for(40), sharding.tree_for(41))
    return out.withColumn("law", F.lit("key"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(_table(spark, sf_dir, "pages")).drop("score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.filled_in(_table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    texts = digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *texts)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = secret_scan.listed(F.filter(spans, lambda s: s["kind"] != "literal"))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    out = secret_scan.scanned(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.listed(spans).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.words(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash_near_dedup, op2_mixing, op3_decontamination, op4_substring_dedup, op5_quality_classifier)
    found += (op6_quality_rules, op7_line_dedup, op8_token_files, op9_hash_tree_sharding, op10_url_filter)
    found += (op11_fill_in_middle, op12_secret_scan, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if k in queries()}
