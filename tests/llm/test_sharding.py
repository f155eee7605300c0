"""Shards and slots against the closed form, for odd sizes and repeated rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from relaywright.llm.sharding import locate, permuted, shard_documents


def hasher(spark, seed, rounds=4, upto=4000):
    """xxhash64(value, seed, round) as Spark has it, for small values."""
    rows = spark.range(upto).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("id", "r", F.xxhash64("id", F.lit(seed), "r").alias("h")).collect()
    known = {(r.id, r.r): r.h for r in rows}
    return lambda value, _seed, r: known[value, r]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 997, 1500])
def test_permutation_and_locate(spark, n):
    seed = 5
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), seed).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    h = hasher(spark, seed)
    for r in rows[:: max(1, n // 50)]:
        assert locate(r.id, n, 16, seed, h) == (r.p % 16, r.p // 16)


def test_documents(spark):
    texts = [(i, f"text {i % 5} é") for i in range(200)] + [(7, None), (None, "x"), (8, "")] + [(9, "same")] * 300
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in texts], "doc_id long, text string, shard string, copies int").repartition(7)
    out = shard_documents(docs).collect()
    assert len(out) == len(texts)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in by_shard.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    want = sorted(((i if i is not None else -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.size, r.text_crc32) for r in out) == want
    again = shard_documents(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))  # a function of the rows, not of their partitions
    assert {r.law for r in out} == {"rows"} and all(r.grown_shard is None for r in out)
    assert shard_documents(docs.limit(0)).count() == 0
