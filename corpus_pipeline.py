"""From raw documents to training tokens: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontam, minhash, quality, substring
from inkwell.llm._shared import release_since, stored, written_so_far
from inkwell.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; one without text (null, empty) goes."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates; documents without an id, and unrelated ones with one id, stay."""
    return minhash.first_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows seen earlier; one without words, or without words left, goes. The text of a document
    that loses none stays as it is."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    out = substring.substring_dedup(docs.select("doc_id", "text", rest), keep=["rest", "text"]).where("n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark. Items without text, or a benchmark without items, take nothing away."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers) of each document, and the digest of what they decode to. Null ids and languages pass through."""
    out = bpe.encode_decode(docs, tokenizer(), keep=["lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]

#: The stages are language models, hashes and tokens: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage leaves behind besides its result is removed when the result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        mark = written_so_far()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            release_since(mark, docs)
    return docs
