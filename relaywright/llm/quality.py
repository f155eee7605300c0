"""Quality scores by positive-unlabelled learning with a non-negative risk.

Only trusted positives and unlabelled text are learned from. With prior p of positives, the risk
is p R(positives as 1) + max(0, R(unlabelled as 0) - p R(positives as 0)): the second term, an
estimate of the risk on negatives, can't be below zero, and where it would be, a step is taken
back. The model is linear in the shares of byte-class pairs and a few counts of words, so the
score of a text needs one pass over its bytes, inside the task that reads it.

With the squared loss a risk hangs on first and second moments alone. One pass sums them over every row
outside the held-out fold, in whole numbers, so that the model is the same however the rows are
dealt. A second pass counts those rows by their margin; the prior is the smallest ratio of unlabelled rows
to positives above a margin, as no more positives than that can be among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import Powers, blocks, give_back, owner, prefix, stretch, table, words
from relaywright.llm.samples import held_out, labelled

#: Bound of the labelled sample that is fitted on, in ids of documents.
POSITIVES = 20_000
#: A text with this score or more is kept.
KEEP_AT = 0.3

_GROUPS = (b"\n\r", b" \t\v\f", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>_\\/", b"()[]{}\"'`-")
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
N_COUNTS = 6
N_FEATURES = N_CLASSES**2 + N_COUNTS
_WORD, _POWERS = table(41), Powers(42)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text of a block, of numbers from 0 to 4; all zeros for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    sizes = np.diff(offsets)
    if len(data) > 1:
        doc = np.repeat(np.arange(n), sizes)
        cls = _CLASS[data]
        inside = doc[1:] == doc[:-1]
        pair = doc[1:] * N_CLASSES**2 + cls[:-1] * N_CLASSES + cls[1:]
        counts = np.bincount(pair[inside], minlength=n * N_CLASSES**2).reshape(n, -1)
        out[:, : N_CLASSES**2] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    starts, ends = words(data, offsets)
    at = owner(offsets, starts)
    n_words = np.bincount(at, minlength=n)
    if len(starts):
        hashes = stretch(prefix(_WORD[data], _POWERS), starts, ends, _POWERS)
        same = np.zeros(len(starts), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
        order = np.lexsort((hashes, at))
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
        distinct = np.bincount(at[order][first], minlength=n)
        some = np.maximum(n_words, 1)
        out[:, -6] = np.bincount(at, weights=same, minlength=n) / some
        out[:, -5] = distinct / some
        out[:, -4] = np.log1p(some) - np.log1p(distinct)
        out[:, -3] = np.minimum(np.bincount(at, weights=ends - starts, minlength=n) / some / 10, 4)
        out[:, -2] = np.bincount(at, weights=(ends - starts) > 20, minlength=n) / some
    out[:, -1] = np.minimum(np.log1p(n_words) / 10, 4)
    return out


#: Features are rounded to such parts when they are summed.
GRAIN = 4096


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of products of the features and a 1, in whole numbers."""
    whole = np.hstack([np.rint(x.astype(np.float64) * GRAIN), np.full((len(x), 1), float(GRAIN))])
    total = np.zeros((whole.shape[1],) * 2, dtype=np.int64)
    for i in range(0, len(whole), 1 << 16):  # products below 2**28, so sums of so many are exact
        part = whole[i : i + (1 << 16)]
        total += (part.T @ part).astype(np.int64)
    return total


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def linear(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that equal texts give equal values."""
        return (x.astype(np.float64) * self.weights).sum(axis=1) + self.bias

    def margins(self, x: np.ndarray) -> np.ndarray:
        """About 1 for good texts and -1 for others."""
        return self.linear(x).clip(-1, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self.margins(x) + 1) / 2


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 200, decay: float = 1e-3) -> QualityModel:
    """From the moments of both: steps on the non-negative risk with the squared loss, each as far as the curvature over the unlabelled asks for."""
    p, u = (m.astype(np.float64) / m[-1, -1] for m in (positive, unlabelled))
    spread = np.sqrt(np.maximum(np.diag(u) - u[-1] ** 2, 0)) + 1e-3
    spread[-1] = 1.0
    p, u = p / np.outer(spread, spread), u / np.outer(spread, spread)
    ridge = decay * np.eye(len(u))
    ridge[-1, -1] = 0
    w = np.zeros(len(u))
    risk = lambda m, y: w @ m @ w - 2 * y * (m[-1] @ w) + 1  # noqa: E731  the mean of (margin - y) ** 2
    slope = lambda m, y: 2 * (m @ w - y * m[-1])
    for _ in range(steps):
        as_zero = slope(u, -1) - prior * slope(p, -1)
        if risk(u, -1) - prior * risk(p, -1) >= 0:
            g = prior * slope(p, 1) + as_zero + 2 * ridge @ w
        else:
            g = -as_zero
        w = w - 0.5 * np.linalg.solve(2 * (u + ridge), g)
    return QualityModel(w[:-1] / spread[:-1], float(w[-1]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives among the unlabelled, from their counts by rising margin: the smallest ratio of the shares above a margin that `least` of the positives reach."""
    p, u = (np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (positive, unlabelled))
    some = p >= least
    return float(np.clip((u[some] / p[some]).min(), 0.02, 0.98)) if some.any() else 0.5


_BINS = 400


def _summed(docs: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all texts of `of(features)`, whole numbers. Each task sums its own; a few tasks sum those, and the driver sees one row of each."""
    schema = T.StructType([T.StructField("sums", T.BinaryType())])

    def add(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for x in parts:
            total += x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=schema.names)
        give_back()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(of(features(data, offsets)) for batch in batches for _, _, data, offsets in blocks(batch.column(0)))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(np.frombuffer(x.as_py(), dtype=np.int64).reshape(shape) for batch in batches for x in batch.column(0))

    rows = docs.select("text").mapInArrow(first, schema).repartition(16).mapInArrow(second, schema).toArrow()
    return sum((np.frombuffer(x.as_py(), dtype=np.int64).reshape(shape) for x in rows["sums"]), np.zeros(shape, dtype=np.int64))


def fit_quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, seed: int = 7) -> QualityModel | None:
    """The model; None without positives or without text outside the held-out fold.

    Positives are the documents with the ids of a bounded sample of those labelled 1, unlabelled ones are all outside the
    fold, their labels unread. Rows that repeat count as often as they stand.
    """
    trusted = labelled(labels, "quality", 1, positives, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unlabelled = rows.filter(~held_out())
    positive = rows.join(F.broadcast(trusted), "doc_id", "left_semi")  # at most `positives` ids
    shape = (N_FEATURES + 1, N_FEATURES + 1)
    p, u = (_summed(x, moments, shape) for x in (positive, unlabelled))
    if not p[-1, -1] or not u[-1, -1]:
        return None
    rough = fit_nnpu(p, u, 0.5)
    # margins beyond 1 in the rough model tell good texts apart as well
    low, high = -2.0, 2.0
    at = lambda x: np.bincount(((rough.linear(x) - low) * (_BINS / (high - low))).clip(0, _BINS - 1).astype(np.int64), minlength=_BINS)
    prior = class_prior(*(_summed(x, at, (_BINS,)) for x in (positive, unlabelled)))
    return fit_nnpu(p, u, prior)


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """`docs` with `score`, 0 to 1, of the whole text; a null text counts as empty. Without a model all score 0.5.

    `score` replaces a column of that name. Rows are neither dropped nor moved; equal texts score alike.
    """
    kept = [c for c in docs.columns if c != "score"]
    source = docs.select(*kept)
    if model is None:
        return source.withColumn("score", F.lit(0.5))
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(model.scores(features(data, offsets)))], names=[*kept, "score"])
        give_back()

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more) of each row of `docs` (doc_id, text).

    Null and empty texts score as texts without words; a null doc_id is of the fold that the empty text falls
    in; rows with equal texts score alike; without positives all score 0.5; an empty table gives no rows; texts of
    any length are scored whole; other columns are not read.
    """
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
