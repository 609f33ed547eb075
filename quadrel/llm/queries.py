"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import bpe, licenses, nearjoin, packing, pii, recipes, repeats, rules, tokens, urls
from quadrel.llm.base import table


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_checksum(tokens.token_output(table(spark, sf_dir, "documents"), BYTE_BPE))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_classes(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), of_judged=True)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.listed("base_list"), 256).alias("base_sha256"), pii.listed("span_list").alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.judge(docs, rules.fit_rules(docs, table(spark, sf_dir, "labels")))
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_dedup, op3_exact_dedup, op4_license_scan, op5_token_output, op6_bpe, op7_ngram_jaccard_join, op8_url_filter, op9_pii, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": recipes.SQL}
