"""Registered queries over this package's operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import bpe, heap_clusters, html_text, language, large_items, minhash, multi_index, oracle, packing, pii, prefix_trie, quality, repeats, warc
from churnlens.llm.common import read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), VOCABULARY)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), VOCABULARY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.transactions(read(spark, sf_dir, "pages"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.cluster(read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large_items.pack(read(spark, sf_dir, "documents"), VOCABULARY)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_warc, op3_repeats, op4_quality, op5_packing, op6_html, op7_language, op8_pii, op9_minhash, op10_ann,
                                    op11_heap_clusters, op12_prefix_trie, op13_bestfit)}


def oracle_sql() -> dict[str, str]:
    """For the other queries SQL can't express the method's part; tests/llm/ compares them with brute force."""
    return dict(oracle.ORACLE)
