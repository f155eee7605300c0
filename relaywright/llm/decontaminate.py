"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A seed is a hash of some of the words of a short window; the words that its mask leaves out may
differ. Seeds of the benchmark are joined with those of each document inside the task that
reads it: the benchmark's are broadcast after a check of their number, and a benchmark with
more is searched in parts that fit, one pass over the documents each. Around a hit, item and document
are laid side by side on the hit's diagonal, and every stretch with a good balance of equal and
different words is kept that is long enough. With a `share`, so is an item of which that share of
words agrees on the diagonal, wherever the others stand; short items have shorter seeds for that,
and those of fewer words than a mask must stand there whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import U64, Powers, as_bytes, blocks, give_back, lower_ascii, mix, owner, prefix, stretch, table, words

#: 1: the word counts, 0: it may differ.
MASKS = ("11011011", "1110010111", "111111")
#: Words that must agree, or all of a shorter item; what a differing word costs against an agreeing one.
MIN_WORDS, DIFFERENCE = 13, 3
#: The share of an item's words that are enough on its diagonal, in production.
SHARE = (3, 4)
#: With a share: further masks, and the fewest and most words of their items. Up to 17 words they find all that have the share.
SHORT_MASKS = (*(("1" * k, k, k) for k in range(1, 6)), ("111", 6, 17), ("11011", 8, 8), ("1111", 18, 35))
#: Candidates that are looked at together.
CANDIDATES = 1 << 19
#: Words of benchmark text that are broadcast at once.
PART_WORDS = 1_000_000
#: Bits that say whether a seed can be in the benchmark.
_FILTER_BITS = 23

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 128) if not chr(b).isalnum()]] = True
_BYTE, _POWERS = table(61, lower_ascii), Powers(62)
_PLACES = [U64(int(x)) for x in np.random.default_rng(63).integers(1, 2**62, 32) * 2 + 1]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end of each word; ASCII case and punctuation don't count, nor words of punctuation only."""
    starts, ends = words(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=U64), starts, starts, starts
    solid = ~_PUNCT[data]
    kept = np.concatenate([[0], np.cumsum(solid)])
    w0, w1 = kept[starts], kept[ends]
    real = w1 > w0
    starts, ends = starts[real], ends[real]
    return stretch(prefix(_BYTE[data[solid]], _POWERS), w0[real], w1[real], _POWERS), owner(offsets, starts), starts, ends


def seeds(hashes: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows under a mask that lie in one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    total = np.full(n, U64(len(mask) * 131 + mask.count("1")), dtype=U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += hashes[i : i + n] * _PLACES[i]
    at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return at, mix(total[at])


@dataclass(frozen=True)
class Benchmark:
    """Items end to end, and their seeds in order; words of each item that are enough on its diagonal, if a share is."""

    item_ids: pa.Array
    hashes: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray]]
    filters: list[np.ndarray]
    masks: list[str]
    enough: np.ndarray | None


def benchmark(item_ids: pa.Array, texts: pa.Array, share: tuple[int, int] | None = None) -> Benchmark:
    data, offsets = as_bytes(texts)
    hashes, item, _, _ = tokens(data, offsets)
    starts = np.searchsorted(item, np.arange(len(item_ids) + 1))
    size = np.diff(starts)
    enough = np.where(size < 6, np.maximum(size, 1), -(-share[0] * size // share[1])) if share else None
    found, filters, masks = [], [], []
    for mask, fewest, most in (*((m, 0, len(hashes)) for m in MASKS), *(SHORT_MASKS if share else ())):
        at, seed = seeds(hashes, item, mask)
        some = (size[item[at]] >= fewest) & (size[item[at]] <= most)
        at, seed = at[some], seed[some]
        masks.append(mask)
        order = np.argsort(seed, kind="stable")
        found.append((seed[order], at[order]))
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(seed >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        filters.append(np.packbits(bits))
    return Benchmark(item_ids, hashes, item, starts, found, filters, masks, enough)


def agreeing(hashes: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, against: Benchmark) -> np.ndarray:
    """Words that agree on the whole diagonal of each of `pairs` (shift, item, text)."""
    shift, item, text = pairs
    i0, i1 = against.starts[item], against.starts[item + 1]
    d0, d1 = np.maximum(i0 + shift, bounds[text]), np.minimum(i1 + shift, bounds[text + 1])
    total = np.zeros(len(shift), dtype=np.int64)
    for k in range(int((d1 - d0).max(initial=0))):
        on = np.flatnonzero(d0 + k < d1)
        at = d0[on] + k
        total[on] += hashes[at] == against.hashes[at - shift[on]]
    return total


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum of 1 for equal and -DIFFERENCE for other words; the earliest of ties."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -DIFFERENCE))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmax(sums[: end + 1] == low[end])), end


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Every stretch of a diagonal with `least` equal words: the best one, then the best before and after it, and so on."""
    out, open_ = [], [(0, len(equal))]
    while open_:
        i, j = open_.pop()
        if int(equal[i:j].sum()) < least:
            continue
        a, b = best_stretch(equal[i:j])
        if int(equal[i + a : i + b].sum()) >= least:
            out.append((i + a, i + b))
        open_ += [(i, i + a), (i + b, j)]
    return sorted(out)


def search(data: np.ndarray, offsets: np.ndarray, against: Benchmark) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start byte, end byte, words agreeing, words of the stretch), start and end in the text."""
    hashes, text, starts, ends = tokens(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    lines: set[tuple[int, int, int]] = set()
    for k, (mask, (known, place), bits) in enumerate(zip(against.masks, against.seeds, against.filters, strict=True)):
        if not len(known):
            continue
        at, seed = seeds(hashes, text, mask)
        key = (seed >> U64(64 - _FILTER_BITS)).astype(np.int64)
        maybe = (bits[key >> 3] >> (7 - (key & 7)).astype(np.uint8)) & 1 == 1
        at, seed = at[maybe], seed[maybe]
        low, high = np.searchsorted(known, seed, side="left"), np.searchsorted(known, seed, side="right")
        some = high > low
        at, low, counts = at[some], low[some], (high - low)[some]
        part = np.cumsum(counts) // CANDIDATES
        for p in np.unique(part):
            count = counts[part == p]
            doc_at = np.repeat(at[part == p], count)
            item_at = place[np.repeat(low[part == p] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            pairs = np.stack([doc_at - item_at, against.item[item_at], text[doc_at]])
            if k >= len(MASKS):  # the seed says little: most go by the number of words that agree
                agree = agreeing(hashes, bounds, pairs, against)
                pairs = pairs[:, agree >= np.minimum(against.enough[pairs[1]], MIN_WORDS)]
            # a diagonal of one item and one document needs one look
            lines.update(map(tuple, np.unique(pairs, axis=1).T.tolist()))
    found = []
    for shift, item, t in lines:
        i0, i1 = int(against.starts[item]), int(against.starts[item + 1])
        d0, d1 = max(i0 + shift, int(bounds[t])), min(i1 + shift, int(bounds[t + 1]))
        equal = hashes[d0:d1] == against.hashes[d0 - shift : d1 - shift]
        hits = [(a, b, int(equal[a:b].sum())) for a, b in stretches(equal, min(MIN_WORDS, i1 - i0))]
        if not hits and against.enough is not None and equal.sum() >= against.enough[item]:
            at = np.flatnonzero(equal)
            hits = [(int(at[0]), int(at[-1]) + 1, len(at))]
        for a, b, agree in hits:
            found.append((t, item, int(starts[d0 + a] - offsets[t]), int(ends[d0 + b - 1] - offsets[t]), agree, b - a))
    return sorted(set(found))


_HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_agree", T.LongType()), T.StructField("n_words", T.LongType())])


def _parts(items: DataFrame, part_words: int) -> list[DataFrame]:
    """The benchmark in parts of about `part_words` words: counted first, then dealt by hash of the item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // part_words)
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _known(docs: DataFrame, items: DataFrame, part_words: int, share: tuple[int, int] | None) -> list:
    """The benchmark, broadcast in parts of about `part_words` words."""
    out = []
    for part in _parts(items, part_words):
        rows = part.orderBy("item_id", "text").toArrow()  # one part of the benchmark: part_words words or about that
        known = benchmark(rows.column("item_id").combine_chunks(), rows.column("text").combine_chunks(), share)
        out.append(docs.sparkSession.sparkContext.broadcast(known))
    return out


def contaminated(docs: DataFrame, items: DataFrame, part_words: int = PART_WORDS, share: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the document's text), n_agree and n_words of each stretch found.

    `docs` has doc_id and text, `items` item_id and text. Null and empty texts match nothing, nor do
    items of fewer words than the shortest mask without a `share` of words that are enough. Null ids are
    passed on as null. Repeated rows give repeated hits; an empty table of either kind gives none. Texts of any length are searched
    whole. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for known in _known(docs, items, part_words, share):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for i, _, data, offsets in blocks(batch.column(1)):
                    hits = search(data, offsets, known.value)
                    if hits:
                        at, item, *rest = (np.array(x) for x in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), known.value.item_ids.take(pa.array(item)), *map(pa.array, rest)], names=_HITS.names)
            give_back()

        found.append(source.mapInArrow(run, _HITS))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _HITS)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: tuple[int, int] | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """`docs` without the rows whose text has a hit, whatever their ids; the others aren't moved or changed. Null and empty texts stay, as do all without items."""
    at = docs.columns.index("text")
    for known in _known(docs, items, part_words, share):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, _, data, offsets in blocks(batch.column(at)):
                    clean[[i + hit[0] for hit in search(data, offsets, known.value)]] = False
                yield batch.filter(pa.array(clean))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
