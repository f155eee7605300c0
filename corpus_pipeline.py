"""A corpus in stages: each reads what the one before kept, and what it decides takes effect."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywright.llm.bpe import round_trip
from relaywright.llm.decontaminate import SHARE, drop_contaminated
from relaywright.llm.jaccard import near_duplicates
from relaywright.llm.quality import KEEP_AT, fit_quality, score_quality
from relaywright.llm.repeats import drop_repeats
from relaywright.llm.runtime import read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject.

    Null and empty texts are judged as texts without words, null doc_ids like others; rows that repeat share their
    fate; an empty table stays empty; columns beside those of documents are dropped.
    """
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).filter(F.col("score") >= KEEP_AT).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8): the one with the smallest doc_id, a null one last; of equal rows one.

    Null and empty texts link with nothing: each doc_id keeps its own. An empty table stays empty; columns beside those of
    documents are dropped. A row is told by its doc_id and 128 bits of hash of its text.
    """
    first = near_duplicates(docs).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    chosen = first.select(F.col("least.doc_id").alias("of"), F.col("least.row").alias("row")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), "text")).withColumn("row_2", F.xxhash64(F.lit(1), "text"))
    kept = keyed.join(chosen, (keyed.row == chosen.row) & keyed.doc_id.eqNullSafe(chosen.of), "left_semi")
    return kept.dropDuplicates(["doc_id", "row", "row_2"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and sentences that an earlier document has.

    All rows stay, null and empty texts as they are; rows that repeat count as one document; n_chars is counted anew; columns
    beside those of documents are dropped.
    """
    return drop_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Each row goes by its own text; null and empty texts stay; columns beside those of documents are dropped."""
    return drop_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), SHARE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: a row for each row, a null text as an empty one."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
