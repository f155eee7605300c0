"""Sharding by a keyed permutation of global row numbers, in DataFrame operations only.

Rows get gapless numbers 0..n-1; a Feistel network over a grid just large enough for n permutes
them, and values outside 0..n-1 walk on along their cycle. With p the permuted number, the shard
is p mod S and the slot is p div S, so counts differ by one at most, slots have no gap, and
`locate` gives the place of any row number without reading data.

Global numbers without a global sort: rows are counted per key bucket (a hash of the row's
identity), the bucket counts, of which there are at most `BUCKETS`, are summed up in order and
broadcast, and rows are numbered inside their bucket. Repeated identical rows are counted before
the shuffle and numbered as one run, so a row that makes up a third of the table is one row here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key buckets; also the bound on the rows of the broadcast table of bucket starts.
BUCKETS = 4096
ROUNDS = 4
#: Steps along a cycle before giving up. Values outside are fewer than sqrt(n) of n, so a walk of this length has odds of n**-31 for large n, and can't happen for n up to 4,000.
WALK = 64
#: Copies of one row that a single generated row stands for.
RUN = 1 << 16


def _step(p: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network on p = left * b + right, left in Z_a, right in Z_b."""
    right = F.pmod(p, b)
    left = ((p - right) / b).cast("long")  # exact below 2**53
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(r)), a), a)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(r)), b), b)
    return left * b + right


def permuted(number: Column, n: Column, seed: int) -> Column:
    """The place of row `number` among n, by cycle walking."""
    n = n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _step(number.cast("long"), a, b, seed),
        lambda p, _: F.when(p < n, p).otherwise(_step(p, a, b, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def locate(row_number: int, n: int, shards: int, seed: int, hash64) -> tuple[int, int]:
    """Shard and slot of a row number; hash64(value, seed, round) is xxhash64 as Spark has it."""
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    p = row_number
    while True:
        left, right = divmod(p, b)
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + hash64(right, seed, r) % a) % a
            else:
                right = (right + hash64(left, seed, r) % b) % b
        p = left * b + right
        if p < n:
            return p % shards, p // shards


def numbered(df: DataFrame, identity: list[str]) -> DataFrame:
    """Distinct rows of `identity` columns with `copies`, the global `first_number` of the run and `n_rows`.

    The order is by key bucket, then by the identity columns (nulls first): a function of the
    rows alone, the same however they are partitioned.
    """
    runs = df.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies"))
    runs = runs.withColumn("bucket", F.pmod(F.xxhash64(*identity), F.lit(BUCKETS)).cast("int"))
    counts = runs.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    # at most BUCKETS rows
    all_counts = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"), F.sum("in_bucket").over(all_counts).alias("n_rows"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in identity]).rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(F.broadcast(starts), "bucket").withColumn("first_number", F.col("bucket_start") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).drop("bucket", "bucket_start")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    size: UTF-8 bytes of the text and 1; a null text has no bytes and the CRC of none, 0. Null
    doc_ids count as the smallest. Rows equal in doc_id and text are interchangeable and share a
    run of numbers. An empty table gives no rows. Other columns are not read. The law is `rows`:
    growing the number of shards deals all rows anew, so grown_shard is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    runs = numbered(rows, ["doc_id", "size", "text_crc32", "text_hash"])
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))
    single = runs.filter("copies = 1").withColumn("number", F.col("first_number"))
    many = (
        runs.filter("copies > 1")
        .withColumn("chunk", chunk)
        .withColumn("within", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + RUN, F.col("copies")) - 1)))
        .withColumn("number", F.col("first_number") + F.col("within"))
        .drop("chunk", "within")
    )
    placed = single.unionByName(many).withColumn("place", permuted(F.col("number"), F.col("n_rows"), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("number").alias("row_number"),
    )
