"""The queries of this subpackage, thin: operators are called with production parameters and digests derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, conversation, decontamination, language_id, license_scan, line_dedup, near_dedup, packing, repetition, sharding, spelling, suffix_dedup, url_filter
from tidemark.llm.common import crc32_of_text


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


#: (host, path, allow) of op1.
URL_RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False)]
#: Where the tokenizer's file is; a parameter of packing.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url", URL_RULES, html="html", addresses=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", suffix_dedup.removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.groups(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", n=2, percent=80)
    return found.withColumnRenamed("component", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, "doc_id", "text", tokenizer_path(), payload=lambda ids: F.crc32(ids).alias("ids_crc32"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _read(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text")
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8)
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", size.alias("size"), crc32_of_text(F.col("text")).alias("text_crc32"))
    return sharding.shard(docs, "doc_id", "size").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return language_id.identify(docs, "text", {"doc_id": F.col("doc_id")}, declared=F.col("lang"), host=F.col("source"), label="lang")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    columns = ("conv_id", "turn", "role", "text")
    return conversation.repair_all(rows, conversation.damage(rows, *columns), *columns)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judge(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.sql(URL_RULES), "op4_license_scan": license_scan.sql(), "op11_conversation_repair": conversation.sql(), "op12_spelling_variants": spelling.sql(), "op13_quality_rules": repetition.sql()}
