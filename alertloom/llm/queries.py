"""The registered queries of the subpackage."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm import (arrow_sequences, avi_clips, bpe_prefix, fast_sketch, feast_whitening, line_edit, pfair_mix, pivot_grams, quality_ratio,
                           secret_owners, simhash_tiles, sparse_suffix, warc_chain)
from alertloom.session import prepare

BYTE_BPE, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_tiles.near_copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_ratio.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "_verdict.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit.classes(table(spark, sf_dir, "documents"), fold=line_edit.FOLD)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.passages(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = warc_chain.write(table(spark, sf_dir, "pages"))
    return warc_chain.read(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_sequences.read(arrow_sequences.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_clips.digests(avi_clips.media(table(spark, sf_dir, "documents")))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.schedule(docs, most_sources=None).select("doc_id", "source", "_mix.*")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast_whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketch.near_copies(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_grams.groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(prepare(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_quality_rules, op3_line_dedup, op4_suffix_array_dedup, op5_warc, op6_byte_bpe, op7_token_output,
             op8_media_columns, op9_secret_scans, op10_source_mix, op11_embedding_whitening, op12_minhash, op13_spelling_variants, pipeline)
    return {fn.__name__: fn for fn in every}


def oracle_sql() -> dict[str, str]:
    """None of these can be put in SQL that DuckDB runs: they rest on XXH64, on tokenizers, on written files or on schedules."""
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
