"""Nearest vectors by collision counting over sorted projections (query-aware LSH).

A block of vectors is projected on `PROJECTIONS` random directions and each projection sorted.
For a query the windows are centred on its own projections; growing the radius (virtual rehashing)
widens them in the same arrays. A vector that falls in the windows of enough projections is
verified by its exact cosine. A query is done at the radius that covers its k-th best: by then a
neighbour as near as that has collided with odds of 0.98 (P(|N(0,1)| <= HALF_WIDTH) in each of PROJECTIONS
draws against THRESHOLD). Only what a radius adds to the windows is counted anew.

Every vector goes to one block, by hash, and is indexed there once; the queries go to every block and
stream past its index, sorted behind the vectors, so a task holds one block whatever the number of
queries. The k best of each query in each block are merged by a window over at most k rows for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaywright.llm.bytetext import give_back

#: Vectors in a block.
VECTORS = 16_384
PROJECTIONS, HALF_WIDTH, THRESHOLD = 16, 1.35, 10
#: Radii on the unit sphere: the first, and the factor to the next.
RADIUS, GROWTH = 0.35, 1.5


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """In double precision, row by row, so that equal vectors give equal values."""
    return (vectors * query).sum(axis=1) / (norms * norm)


class Index:
    """A block of vectors and its sorted projections. `copies`: how often each row stands in the table."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, hashes: np.ndarray, copies: np.ndarray, seed: int = 19):
        self.vectors, self.ids, self.hashes, self.copies = vectors, ids, hashes, copies
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.norms[:, None]
        self.lines = np.random.default_rng(seed).standard_normal((PROJECTIONS, vectors.shape[1]))
        values = self.unit @ self.lines.T
        order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        self.ordered = [np.ascontiguousarray(values[order[:, j], j]) for j in range(PROJECTIONS)]
        self.order = [np.ascontiguousarray(order[:, j]) for j in range(PROJECTIONS)]
        self.radii = [RADIUS]
        while self.radii[-1] < 2:  # which is all of the sphere
            self.radii.append(self.radii[-1] * GROWTH)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, hashes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, cosines and copies of the k nearest found for each query; of the query's own row, only further copies count."""
        n, query_norms = len(self.ids), np.sqrt((queries * queries).sum(axis=1))
        query_unit = queries / query_norms[:, None]
        centres = query_unit @ self.lines.T
        ends = np.empty((len(self.radii), 2, PROJECTIONS, len(queries)), dtype=np.int64)
        for r, radius in enumerate(self.radii):
            for j in range(PROJECTIONS):
                ends[r, 0, j] = np.searchsorted(self.ordered[j], centres[:, j] - HALF_WIDTH * radius, side="left")
                ends[r, 1, j] = np.searchsorted(self.ordered[j], centres[:, j] + HALF_WIDTH * radius, side="right")
        for q in range(len(queries)):
            found, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
            counts = np.zeros(n, dtype=np.int64)
            own = (self.ids == ids[q]) & (self.hashes == hashes[q])
            verified = own & (self.copies == 1)
            low = high = ends[0, 0, :, q].tolist()
            for r, radius in enumerate(self.radii):
                now_low, now_high = ends[r, 0, :, q].tolist(), ends[r, 1, :, q].tolist()
                parts = [self.order[j][now_low[j] : low[j]] for j in range(PROJECTIONS)] + [self.order[j][high[j] : now_high[j]] for j in range(PROJECTIONS)]
                counts += np.bincount(np.concatenate(parts), minlength=n)
                low, high = now_low, now_high
                fresh = np.flatnonzero((counts >= (THRESHOLD if radius < 2 else 0)) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    # a quick product picks those that can be among the k best; only they need the exact one
                    near = self.unit[fresh] @ query_unit[q]
                    if len(near) > k:
                        fresh = fresh[near >= np.partition(near, -k)[-k] - 1e-9]
                    found = np.concatenate([found, fresh])
                    scores = np.concatenate([scores, cosines(self.vectors[fresh], self.norms[fresh], queries[q], query_norms[q])])
                if len(found) >= k and math.sqrt(max(0.0, 2 - 2 * np.partition(scores, -k)[-k])) <= radius:
                    break
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield found[best], scores[best], self.copies[found[best]] - own[found[best]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), h (its hash), dim and copies (how often the row stands there), without the vectors that take no part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda x: x != 0))
    once = rows.withColumn("h", F.xxhash64("v")).groupBy("vec_id", "h").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    return once.withColumn("dim", F.size("v"))


_FOUND = "query_id long, qh long, repeats long, vec_id long, score double, copies long"


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, block: int = VECTORS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    score is the cosine of the original vectors; ties go to the smaller vec_id. Null vec_ids and
    vectors that are null, zero, or hold null or non-finite components take no part; vectors of different
    length aren't compared. Of rows that repeat in full each is a candidate and, if it asks, a query of its own. Fewer
    candidates than k give fewer rows, none give none. Other columns are not read.
    """
    rows = usable(vectors)
    n = rows.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = -(-n // block)
    here = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "h", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    there = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, index = None, [], None
        for batch in batches:
            dim, at, asks, ids, hashes, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "block", "asks", "vec_id", "h", "copies"))
            v = batch.column(batch.schema.get_field_index("v"))
            change = np.flatnonzero((np.diff(dim, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0) | np.append(True, asks[1:] != asks[:-1]))
            for a, b in zip(change.tolist(), [*change[1:].tolist(), len(dim)], strict=True):
                if (dim[a], at[a]) != current:
                    current, parts, index = (dim[a], at[a]), [], None
                matrix = v.slice(a, b - a).flatten().to_numpy().reshape(-1, dim[a])
                if not asks[a]:
                    parts.append((matrix, ids[a:b], hashes[a:b], copies[a:b]))
                    continue
                if index is None and parts:
                    index, parts = Index(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                if index is None:
                    continue
                for i in range(0, len(matrix), 1024):
                    out = [[] for _ in range(6)]
                    asking = range(a + i, a + min(i + 1024, len(matrix)))
                    for q, (found, score, times) in zip(asking, index.nearest(matrix[i : i + 1024], ids[a + i : b], hashes[a + i : b], k), strict=True):
                        for column, x in zip(out, (np.full(len(found), ids[q]), np.full(len(found), hashes[q]), np.full(len(found), copies[q]), index.ids[found], score, times), strict=True):
                            column.append(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "qh", "repeats", "vec_id", "score", "copies"])
        give_back()

    partitions = max(blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = here.unionByName(there).repartition(partitions, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    found = dealt.mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # a row that stands there several times takes as many ranks
    spread = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return spread.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("query_id", "rank", "vec_id", "score")
