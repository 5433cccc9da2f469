"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoflow.llm import (
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    oracles,
    permutation_index,
    pii,
    sentencepiece_viterbi,
    sharding,
    token_store,
    url_filters,
)
from kinoflow.llm.common import hub_join, passing, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By text and source; lang is what the model is fitted on, so it isn't evidence too."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs), host_col="source")
    return found.select("doc_id", "language", "probability", "text_language", "accepted")


def op2_pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with a model of documents: by text, declared markup, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filters.host_and_path(F.col("url"))
    pages = pages.withColumn("host", F.nullif(host, F.lit("")))
    found = language_id.identify(pages, language_id.fit(table(spark, sf_dir, "documents")), text_col="html", host_col="host")
    return found.select("page_id", "language", "probability", "text_language", "accepted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_bounded(table(spark, sf_dir, "documents"), 24)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again: exact says that decoding gave the text back."""
    pieces = sentencepiece_viterbi.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece_viterbi.round_trip(docs, pieces)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        "exact",
    )


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is removed when the driver's JVM ends: the query's result is what is read back from it."""
    path = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end=2)
    passing(spark, path)
    return token_store.read_index(spark, path)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filters.filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_aliases_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with redirects: each to the first address of its path, whatever the host."""
    pages = table(spark, sf_dir, "pages")
    paths = pages.select("url", url_filters.host_and_path(F.col("url"))[1].alias("path")).where("path != ''")
    first = paths.groupBy(F.col("path").alias("of")).agg(F.min("url").alias("target"), F.count("*").alias("n"))
    links = hub_join(paths, first, "path", "of", "n", paths.count()).select("url", "target")
    found = url_filters.filter_urls(pages, redirects=links)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_permutation_index, op2_language_id, op2_pages_language_id, op3_decontamination, op4_bounded_ring_sharding, op5_sentencepiece,
        op6_content_store, op7_url_filter, op7_aliases_by_path, op8_pii, op9_minhash_near_dedup, op10_line_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query; queries that SQL can't express are held against plain versions in the tests."""
    return {
        "op3_decontamination": oracles.CONTAMINATION,
        "op7_url_filter": oracles.URLS,
        "op7_aliases_by_path": oracles.URLS_BY_PATH,
        "op9_minhash_near_dedup": oracles.NEAR,
        "op10_line_dedup": oracles.LINES,
    }
