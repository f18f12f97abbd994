"""A corpus pipeline over ``documents``: rules, lines, near copies, mixing, token ids."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertloom.llm import bpe_prefix, line_edit, pfair_mix, quality_ratio, simhash_jaccard
from alertloom.llm.common import stored
from alertloom.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    return quality_ratio.keep_good(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier or nearly so."""
    prepare(spark)
    return line_edit.dedup(docs, fold=line_edit.FOLD)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    prepare(spark)
    return simhash_jaccard.keep_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives each source its share of every prefix."""
    prepare(spark)
    return pfair_mix.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: number, digests and the place that mixing gave it.

    ``docs`` must be read from the files that the mixing stage wrote: their numbers and rows hold the places."""
    prepare(spark)
    return bpe_prefix.round_trip(pfair_mix.places(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "place")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_near_dedup),
          ("mixing sources to target weights", source_mix), ("byte-level BPE encoding and decoding", byte_bpe)]
# XXH64, banded joins and the tokenizer are outside SQL: tests compare the rows with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
