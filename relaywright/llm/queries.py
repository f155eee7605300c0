"""The queries of the training-data operators, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywright.llm.bpe import round_trip
from relaywright.llm.decontaminate import SHARE, contaminated
from relaywright.llm.jaccard import near_duplicates
from relaywright.llm.maintext import extract
from relaywright.llm.neighbours import nearest
from relaywright.llm.quality import quality_table
from relaywright.llm.repeats import drop_repeats
from relaywright.llm.runtime import read
from relaywright.llm.sharding import shard_documents
from relaywright.llm.substrings import drop_substrings
from relaywright.llm.toxicity import toxicity_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=16)


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op8_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


@_query
def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), share=SHARE)


@_query
def op2_divideskip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4, share=(85, 100)).select("doc_id", "n_shingles", "component_id")


@_query
def op9_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), every=50, k=5)


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans")
