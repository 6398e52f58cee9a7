"""The registered queries over the corpus tables: name to function of (spark, sf_dir), and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, html, importance, minhash, mixing, quality, sharding, substring, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_language_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Bytes of a shard in the query: so few that all but the smallest tables split.
SHARD = 1 << 20


def op9_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD).drop("text")


def op10_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents"))).select("row.doc_id", "size", "source_size", "target", "taken")


def op12_feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_classifier_chain": op1_classifier_chain,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_fingerprint_log": op4_fingerprint_log,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op6_line_blocks": op6_line_blocks,
    "op7_language_model_ratio": op7_language_model_ratio,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_extendible_hashing": op9_extendible_hashing,
    "op10_term_at_a_time": op10_term_at_a_time,
    "op11_block_mix": op11_block_mix,
    "op12_feature_dictionary": op12_feature_dictionary,
    "op13_mask_histogram": op13_mask_histogram,
}

ORACLE_SQL: dict[str, str] = {
    "op9_extendible_hashing": sharding.sql(SHARD),
    "op10_term_at_a_time": topk.SQL,
    "op13_mask_histogram": audit.SQL,
}
