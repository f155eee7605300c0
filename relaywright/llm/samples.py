"""Bounded samples for fitting: the fold that may be learned from, and rows picked by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are held out of all learning.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def pick(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most `bound` distinct doc_ids, those with the smallest hashes: spread over the table, the same on each run."""
    return rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)


def labelled(labels: DataFrame, column: str, value: int, bound: int, seed: int) -> DataFrame:
    """A bounded sample of the ids outside the held-out fold with that label; null labels are none."""
    return pick(labels.filter((F.col(column) == value) & ~held_out()), bound, seed)
