"""Repeated substrings: every byte covered by a 50-byte string that an earlier document holds.

A sparse suffix array, built bucket by bucket. Sampled positions (anchors) are the minima of a
hash of q-grams over each window of 50 bytes, the leftmost of equals: the choice hangs on the window
alone, so equal windows have the same anchor in them. The initial buckets are the anchors' q-grams.
The windows of one anchor make up a unit, a stretch of some 60 bytes. Q-grams are long enough that
few units share one by chance, however large the table.

1. Buckets are sorted on the identifiers of their units: whole units that an earlier document
   holds are done. Copies inside a task are settled there; only the first of each goes on.
2. Buckets with different units are refined by bucket pointers: their places go to the documents
   for their bytes, then positions of all units are bucketed by their first 16 bytes and sorted on
   pairs of bucket identifiers, their own and the one 16 bytes on, then 18 of the refined ones:
   50 bytes. Each round reuses what the one before has updated, and leaves out positions that no
   window leads to, and those that are alone in their bucket or lead to one that is.
3. The stretches found go to their documents, which are cut.

Work is dealt in buckets of bounded size, by ranges of the q-grams' hashes; a chunk hands on
what it has for a bucket as one payload, at 10 GB of text some thousand anchors. A q-gram with more than
about `HOT_ROWS` occurrences is dealt by its units instead; one whose units are too many to
be refined in one bucket has its windows compared by a minimum per window, which Spark combines
before the shuffle. A row is told from others by its doc_id and 128 bits of hash of its text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import U64, Powers, as_bytes, blocks, give_back, mix, owner, prefix, stretch, table
from relaywright.llm.runtime import materialise

#: Length of the strings, and of the q-grams that anchors are chosen by.
LENGTH, GRAM = 50, 24
#: Bits of a q-gram's hash that aren't kept.
GRAM_SHIFT = U64(16)
#: Bytes of text for each bucket of anchors, and of units that are refined at once; `DEALT` times as many are dealt together.
BUCKET_BYTES, REFINED_BYTES, DEALT = 12 << 20, 1 << 20, 4
#: Bytes that the first buckets of the refinement are equal in.
FIRST = 16
#: Anchors that a task settles among themselves before it passes them on.
CHUNK = 1 << 20
#: Bytes of text whose anchors are looked for at once; of a longer text, so many at a time.
BLOCK = 1 << 18
#: A q-gram with over twice as many occurrences is hot, one with fewer than these isn't.
HOT_ROWS = 500_000
#: Ids with several texts that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_BYTE, _POWERS = table(91), Powers(92)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def located(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the bytes, and q-gram hash, text, first and last window of each anchor."""
    width, n = length - gram + 1, len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none.view(U64), none.view(U64), none, none, none
    sums = prefix(_BYTE[data], _POWERS)
    grams = (sums[gram:] - sums[:-gram]) * _POWERS.upto(n + 1)[1][: n - gram + 1]
    rank = (grams >> U64(32)).astype(np.uint32)
    least = sliding(rank, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint32)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == rank)
    # windows go to the next anchor where it enters, if it is lower, else where the one before leaves
    value = rank[at]
    first = np.zeros(len(at), dtype=np.int64)
    first[1:] = np.where(value[1:] < value[:-1], at[1:] - width + 1, at[:-1] + 1)
    # an equal of the one before is left without a window where a lower one enters by then
    alive = first < np.append(np.minimum.accumulate(first[:0:-1])[::-1], n)
    at, first = at[alive], first[alive]
    last = np.append(first[1:] - 1, n - length)
    text = owner(offsets, at)
    first, last = np.maximum(first, offsets[text]), np.minimum(last, offsets[text + 1] - length)
    some = first <= last
    at, first, last, text = at[some], first[some], last[some], text[some]
    # minima are small hashes: mixed, they are spread over all of the range; q-grams that share these bits have different units
    return sums, mix(grams[at]) >> GRAM_SHIFT << GRAM_SHIFT, text, first, last


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Q-gram hash, unit hash, text, start of the first window in the text and number of windows of each anchor."""
    sums, grams, text, first, last = located(data, offsets, length, gram)
    return grams, stretch(sums, first, last + length, _POWERS), text, first - offsets[text], last - first + 1


#: Length, bytes of a value, and which of these aren't all zero.
_HEADER = struct.Struct("<IBB")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as their length and those byte planes that aren't all zero."""
    parts = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
        used = planes.any(axis=1)
        parts += [_HEADER.pack(len(x), x.dtype.itemsize, sum(1 << i for i in np.flatnonzero(used).tolist())), (planes if used.all() else planes[used]).tobytes()]
    return b"".join(parts)


def unpack(raw: bytes) -> list[np.ndarray]:
    """Unsigned arrays."""
    out, i = [], 0
    while i < len(raw):
        n, size, used = _HEADER.unpack_from(raw, i)
        i += _HEADER.size
        planes = np.zeros((size, n), dtype=np.uint8)
        present = [k for k in range(size) if used >> k & 1]
        planes[present] = np.frombuffer(raw, dtype=np.uint8, count=n * len(present), offset=i).reshape(len(present), n)
        i += n * len(present)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(n))
    return out


class Chunk:
    """Anchors of some documents, gathered until there are enough to settle. A row that is equal to one before is left out."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.clear()

    def clear(self) -> None:
        self.parts, self.keys, self.size, self.docs, self.seen = [], [], 0, 0, set()

    def add(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, base: int = 0) -> None:
        """`keys`: doc_id and the two hashes of each text; `base`: where the first begins in its document."""
        grams, unit, text, start, count = anchors(data, offsets, self.length, self.gram)
        fresh = np.ones(len(keys), dtype=bool)
        for k, key in enumerate(map(bytes, keys)):
            fresh[k] = (key, base) not in self.seen
            self.seen.add((key, base))
        if not fresh.all():
            some = fresh[text]
            grams, unit, text, start, count = grams[some], unit[some], text[some], start[some], count[some]
        self.parts.append([grams, unit, *(x.astype(np.uint32) for x in (text + self.docs, start + base, count))])
        self.keys.append(keys)
        self.docs += len(keys)
        self.size += len(grams)

    def take(self) -> dict[str, np.ndarray]:
        """All that was gathered, in the order of q-gram, unit and document, and which rows an earlier document of the chunk settles."""
        grams, unit, which, start, count = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        keys = np.concatenate(self.keys)
        self.clear()
        doc = keys[:, 0][which].view(np.int64)
        order = ordered(grams, unit, doc)
        out = dict(zip(("grams", "unit", "which", "start", "count", "doc"), (c[order] for c in (grams, unit, which, start, count, doc)), strict=True))
        out["keys"] = keys
        out["settled"] = out["doc"] > firsts(out["grams"], out["unit"], out["doc"])
        return out


def sorted_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of `key`, and whether each has the same as the one before, both but for the lowest bits: the numbers of the rows take their place, so values are sorted alone."""
    bits = U64(max(1, (len(key) - 1).bit_length()))
    packed = np.sort(key >> bits << bits | np.arange(len(key), dtype=U64))
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    packed >>= bits
    same = np.zeros(len(key), dtype=bool)
    same[1:] = packed[1:] == packed[:-1]
    return order, same


def ordered(gram: np.ndarray, unit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows in the order of q-gram, unit and document; all three are looked at where q-grams may be equal."""
    order, same = sorted_rows(gram)
    same[:-1] |= same[1:]
    at = np.flatnonzero(same)
    some = order[at]
    order[at] = some[np.lexsort((doc[some], unit[some], gram[some]))]
    return order


def firsts(gram: np.ndarray, unit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows in order, the first document of each row's unit."""
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1])
    return doc[new][np.cumsum(new) - 1] if len(gram) else doc


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """doc_id, t1 and t2 of each row, which are the first columns."""
    return np.stack([batch.column(i).to_numpy().view(U64) for i in range(3)], axis=1)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts (first row, end row, 0, bytes, offsets); of a text longer than a block, pieces that overlap so that each window is in one, with where they begin."""
    for i, j, data, offsets in blocks(column, BLOCK):
        for base in range(0, max(len(data), 1), BLOCK if j == i + 1 else max(len(data), 1)):
            piece = data[base : base + BLOCK + length - 1] if j == i + 1 else data
            yield i, j, base, piece, np.array([0, len(piece)]) if j == i + 1 else offsets


def _chunks(batches: Iterator[pa.RecordBatch], length: int, gram: int, chunk: int) -> Iterator[dict[str, np.ndarray]]:
    gathered = Chunk(length, gram)
    for batch in batches:
        keys = _keys(batch)
        for i, j, base, data, offsets in _pieces(batch.column(3), length):
            gathered.add(keys[i:j], data, offsets, base)
            if gathered.size >= chunk:
                yield gathered.take()
    if gathered.size:
        yield gathered.take()


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of q-gram hashes."""
    return ((grams >> U64(32)) * U64(buckets)) >> U64(32)


def _base(bucket: int, buckets: int) -> np.uint64:
    """Not above any q-gram hash of the bucket, and near the lowest."""
    return U64(((bucket << 32) // buckets) << 32)


_BYTES = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType())])


def _dealt(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Some megabytes of payloads in each batch."""
    buckets, payloads, size = [], [], 0
    for bucket, payload in rows:
        buckets.append(bucket)
        payloads.append(payload)
        size += len(payload)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], names=_BYTES.names)
            buckets, payloads, size = [], [], 0
    if buckets:
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], names=_BYTES.names)


def _partitioned(rows: DataFrame, least: int) -> DataFrame:
    """Dealt by bucket to as many partitions as are usual, and more where there are that many buckets."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that occur, and their rows as they stand."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")  # of 16 bits by radix
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _present(which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of n documents that occur, and the place of each row's among them."""
    if n > 4 * len(which):
        present, place = np.unique(which, return_inverse=True)
        return present, place.astype(np.uint32)
    seen = np.zeros(n, dtype=bool)
    seen[which] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[which]


def _hot_grams(docs: DataFrame, size: int, s: dict) -> np.ndarray:
    """Q-grams with more than about `hot_rows` occurrences; there are at most all anchors / hot_rows.

    What a piece of a task holds so rarely that all pieces together stay below `hot_rows` isn't counted.
    """
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    pieces = size // (4 * s["chunk"]) + docs.rdd.getNumPartitions()  # an anchor takes four bytes at least, but for odd texts
    local = max(2, s["hot_rows"] // pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            some = n >= local
            return pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(n[some])], names=schema.names)

        for batch in batches:
            for _, _, _, data, offsets in _pieces(batch.column(3), s["length"]):
                parts.append(located(data, offsets, s["length"], s["gram"])[1])
                held += len(parts[-1])
                if held >= 2 * s["chunk"]:
                    yield counted()
                    parts, held = [], 0
        if held:
            yield counted()
        give_back()

    found = docs.mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > s["hot_rows"]).select("gram")
    return np.sort(found.toArrow()["gram"].to_numpy().view(U64))


#: Stretches of windows of a document end to end: in bytes, as no one but these tasks looks into them.
_STRETCH = np.dtype([("start", "<u4"), ("count", "<u4"), ("gram", "<u8")])
_FOUND = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "t1", "t2")), T.StructField("asks", T.IntegerType()), T.StructField("stretches", T.BinaryType())])
#: Of `asks`: found in an earlier document; bytes asked for; asked for, of a q-gram with too many units for one bucket.
FOUND, NARROW, WIDE = 0, 1, 2


def _by_document(keys: np.ndarray, which: np.ndarray, start: np.ndarray, count: np.ndarray, asks: int = FOUND, grams: np.ndarray | None = None) -> pa.Table:
    """A row for each document with stretches of windows, each once. `which` are rows of `keys`, where a document can stand more than once."""
    present, which = _present(which, len(keys))
    keys = keys[present]
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0])) if keys[:, 1:].any() else np.argsort(keys[:, 0], kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    rank = np.empty(len(keys), dtype=np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    keys, doc = keys[new], rank[which]
    order = np.argsort(doc.astype(U64) << U64(32) | start.astype(U64), kind="stable")
    doc = doc[order]
    out = np.zeros(len(doc), dtype=_STRETCH)
    out["start"], out["count"] = start[order], count[order]
    if grams is not None:
        out["gram"] = grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    once = new.copy()
    once[1:] |= (out["start"][1:] != out["start"][:-1]) | (out["count"][1:] != out["count"][:-1])
    ends = np.append(np.flatnonzero(new[once]), once.sum()) * _STRETCH.itemsize
    first = keys[doc[new]].view(np.int64)
    stretches = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out[once].tobytes())])
    return pa.table([*(pa.array(np.ascontiguousarray(first[:, i])) for i in range(3)), pa.array(np.full(len(first), asks, dtype=np.int32)), stretches], names=_FOUND.names)


class _Payloads:
    """Columns of the payloads of a bucket, and the keys of their documents end to end."""

    def __init__(self, n: int):
        self.columns: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.keys, self.docs = [], 0

    def place(self, key: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        self.keys.append(np.stack(key, axis=1))
        self.docs += len(key[0])
        return which + np.uint32(self.docs - len(key[0]))

    def add(self, *columns: np.ndarray) -> None:
        for c, x in zip(self.columns, columns, strict=True):
            c.append(x)

    def take(self) -> tuple[np.ndarray, ...]:
        """The keys, and each column."""
        out = np.concatenate(self.keys), *map(np.concatenate, self.columns)
        self.columns, self.keys = [], []
        return out


def _whole_units(docs: DataFrame, buckets: int, hot, s: dict) -> DataFrame:
    """By document: units that an earlier document holds, and those whose q-gram has different units, of which the bytes are asked for."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for c in _chunks(batches, s["length"], s["gram"], s["chunk"]):
                grams, unit, which, start, count, settled, keys = (c[k] for k in ("grams", "unit", "which", "start", "count", "settled", "keys"))
                bucket = _bucket(grams, buckets)
                loose = _isin(grams, hot.value)
                bucket[loose] = mix(unit[loose]) % U64(buckets)
                # those that are settled only pass through, anywhere
                bucket[settled] = mix(keys[which[settled]].sum(axis=1, dtype=U64)) % U64(buckets)
                for b, at in _by_bucket(bucket):
                    at = np.concatenate([at[~settled[at]], at[settled[at]]])  # stays in the order of q-grams otherwise
                    n = int(len(at) - settled[at].sum())
                    deltas = np.diff(grams[at[:n]] - _base(b, buckets), prepend=U64(0))
                    present, place = _present(which[at], len(keys))
                    yield b, pack(deltas, unit[at[:n]] >> U64(24), *(np.ascontiguousarray(keys[present, i]) for i in range(3)), place, start[at], count[at])

        yield from _dealt(rows())
        give_back()

    def settle(whole: pa.Table) -> pa.Table:
        gathered = _Payloads(8)
        base = _base(whole.column("bucket")[0].as_py(), buckets)
        for payload in whole.column("payload"):
            deltas, unit, *key, which, start, count = unpack(payload.as_py())
            n, which = len(deltas), gathered.place(key, which)
            gathered.add(np.cumsum(deltas, dtype=U64) + base, unit, which[:n], start[:n], count[:n], which[n:], start[n:], count[n:])
        keys, gram, unit, which, start, count, *done = gathered.take()
        doc = keys[:, 0].view(np.int64)[which]
        order = ordered(gram, unit, doc)
        gram, unit, which, doc, start, count = (x[order] for x in (gram, unit, which, doc, start, count))
        again = doc > firsts(gram, unit, doc)
        new = np.ones(len(gram), dtype=bool)
        new[1:] = gram[1:] != gram[:-1]
        differs = np.zeros(len(gram), dtype=np.int64)  # the q-gram has another unit before
        differs[1:] = ~new[1:] & (unit[1:] != unit[:-1])
        begins, of = np.flatnonzero(new), np.cumsum(new) - 1
        units, left = (np.add.reduceat(x, begins) if len(gram) else x[:0] for x in (differs, (~again).astype(np.int64)))
        is_hot = _isin(gram, hot.value)
        asks = ~again & ((units[of] > 0) | is_hot)
        wide = is_hot | (left[of] > s["refined_bytes"] // (2 * s["length"]))
        del order, doc, unit, new, differs, of
        out = [_by_document(keys, *(np.concatenate([a[again], b]) for a, b in zip((which, start, count), done, strict=True)))]
        for kind in (NARROW, WIDE):
            some = asks & (wide == (kind == WIDE))
            out.append(_by_document(keys, which[some], start[some], count[some], kind, gram[some]))
        give_back()
        return pa.concat_tables(out)

    return _partitioned(docs.mapInArrow(deal, _BYTES), buckets).groupBy("bucket").applyInArrow(settle, _FOUND)


def refine(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the positions of some units to buckets of `length` equal bytes.

    Gives the window starts that aren't alone, their units, and their buckets.
    """
    n, count = len(data), lengths - (length - 1)
    depth = FIRST if length >= FIRST else 8
    steps = []
    while depth + sum(steps) < length:
        steps.append(min(depth + sum(steps), length - depth - sum(steps)))
    # at the last depth the starts of windows are needed, at each one before also what their pointers lead to
    needed = [np.zeros(n, dtype=bool)]
    needed[0][np.repeat(begins - np.cumsum(count) + count, count) + np.arange(count.sum())] = True
    for step in reversed(steps):
        needed.append(needed[-1].copy())
        needed[-1][step:] |= needed[-2][:-step]
    at = np.flatnonzero(needed.pop())
    wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = np.ndarray((n + 1,), dtype="<u8", buffer=wide, strides=(1,))  # of 8 bytes, at each position
    bucket, lonely = np.zeros(n, dtype=np.uint32), np.ones(n, dtype=bool)
    number, alone = _number(*(word[at + i] for i in range(0, depth, 8)))
    bits = U64(n.bit_length())
    for step in steps:
        bucket[at], lonely[:] = number, True
        lonely[at] = alone
        # sorted on the pair of bucket identifiers, the second at the later offset; who is alone, or whose second is, already stays so
        at = np.flatnonzero(needed.pop() & ~lonely)
        at = at[~lonely[at + step]]
        number, alone = _number(bucket[at].astype(U64) << bits | bucket[at + step].astype(U64))
    at = at[~alone]
    return at, np.repeat(np.arange(len(begins)), lengths)[at], number[~alone]


def _number(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the buckets of equal values; gives the numbers and which of them are alone."""
    n = len(values[0])
    fits = len(values) == 1 and n and int(values[0].max()) >> (64 - n.bit_length()) == 0
    key = values[0] << U64(n.bit_length()) if fits else values[0].astype(U64)
    if not fits:
        for v in values[1:]:
            key = mix(key) ^ v
        key = mix(key)
    order, same = sorted_rows(key)
    again = np.flatnonzero(same)
    if not fits and any((v[order[again]] != v[order[again - 1]]).any() for v in values):  # different ones share the bits that were sorted on
        order = np.lexsort(values)
        same[1:] = np.logical_and.reduce([v[order[1:]] == v[order[:-1]] for v in values])
    number, alone = np.empty(n, dtype=np.uint32), np.empty(n, dtype=bool)
    number[order] = np.cumsum(~same, dtype=np.uint32) - np.uint32(1)
    alone[order] = ~same & np.append(~same[1:], True)[:n]
    return number, alone


def _runs(unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions in the same unit: unit, first, how many. `at` is in order."""
    if not len(at):
        return unit, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (unit[1:] != unit[:-1])
    first = np.flatnonzero(new)
    return unit[first], at[first], np.diff(np.append(first, len(at)))


def _asked(asks: DataFrame, packed: DataFrame) -> DataFrame:
    """The units that are asked for of each document, beside its text."""
    by_document = asks.groupBy("doc_id", "t1", "t2").agg(F.collect_list("stretches").alias("stretches"))
    return packed.select("doc_id", "t1", "t2", "packed").join(by_document, ["doc_id", "t1", "t2"])


def _stretches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a column of lists, and the row of each."""
    data, ends = as_bytes(column.flatten())
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    per_row = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]) // _STRETCH.itemsize
    return np.ascontiguousarray(data).view(_STRETCH), np.repeat(np.arange(len(column)), per_row)


def _units(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Keys of documents; rows of them, starts, counts, q-grams and bytes of units, about `chunk` at a time; of equal rows that stand together one is read."""
    held, parts, texts, docs, before = [], [], [], 0, None
    for batch in batches:
        keys = _keys(batch)
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        fresh[:1] = before is None or (keys[:1] != before).any()
        before = keys[-1:] if len(keys) else before
        packed, asked = (batch.column(batch.schema.get_field_index(c)) for c in ("packed", "stretches"))
        of, row = _stretches(asked)
        data, offsets = as_bytes(packed)
        whole = memoryview(data)
        some = np.flatnonzero(fresh[row])
        for a in range(0, len(some), chunk):
            i = some[a : a + chunk]
            start, count = of["start"][i], of["count"][i]
            first = offsets[row[i]] + start
            texts += [bytes(whole[x:y]) for x, y in zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True)]
            present, place = _present(row[i], len(keys))
            held.append(keys[present])
            parts.append((place + np.uint32(docs), start, count, of["gram"][i]))
            docs += len(present)
            if len(texts) >= chunk:
                yield np.concatenate(held), *(np.concatenate(c) for c in zip(*parts, strict=True)), texts
                held, parts, texts, docs = [], [], [], 0
    if parts:
        yield np.concatenate(held), *(np.concatenate(c) for c in zip(*parts, strict=True)), texts


def _parts_of_units(asked: DataFrame, buckets: int, s: dict) -> DataFrame:
    """Windows that an earlier document holds in another unit of the same q-gram."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for keys, which, start, count, grams, texts in _units(batches, s["length"], s["chunk"] // 4):
                mixed = mix(grams)
                for b, at in _by_bucket(mixed % U64(buckets)):
                    present, place = _present(which[at], len(keys))
                    text = np.frombuffer(b"".join(map(texts.__getitem__, at.tolist())), dtype=np.uint8)
                    yield b, pack((mixed[at] >> U64(32)).astype(np.uint32), *(np.ascontiguousarray(keys[present, i]) for i in range(3)), place, start[at], count[at], text)

        yield from _dealt(rows())
        give_back()

    def settle(whole: pa.Table) -> pa.Table:
        gathered = _Payloads(5)
        for payload in whole.column("payload"):
            gram, *key, which, start, count, data = unpack(payload.as_py())
            gathered.add(gram, gathered.place(key, which), start, count.astype(np.int64) + (s["length"] - 1), data)
        keys, gram, which, start, lengths, data = gathered.take()
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(gram, kind="stable")
        # as many whole q-grams at once as bytes allow
        new = np.flatnonzero(np.diff(gram[order].astype(np.int64), prepend=-1))
        size = np.cumsum(lengths[order])[np.append(new[1:], len(order)) - 1]
        cuts = np.append(new[np.flatnonzero(np.diff((size - 1) // s["refined_bytes"], prepend=-1))], len(order))
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = order[a:b]
            n = lengths[some]
            ends = np.cumsum(n)
            at, unit, bucket = refine(data[np.repeat(begins[some] - ends + n, n) + np.arange(ends[-1])], ends - n, n, s["length"])
            doc = keys[:, 0].view(np.int64)[which[some]]
            least = np.full(int(bucket.max()) + 1 if len(bucket) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, bucket, doc[unit])
            again = doc[unit] > least[bucket]
            unit, first, windows = _runs(unit[again], at[again])
            found.append((which[some][unit], start[some][unit] + first - (ends - n)[unit], windows))
        out = _by_document(keys, *map(np.concatenate, zip(*found, strict=True)))
        give_back()
        return out

    return _partitioned(asked.mapInArrow(deal, _BYTES), buckets // 2).groupBy("bucket").applyInArrow(settle, _FOUND)


def _wide_windows(asked: DataFrame, s: dict) -> DataFrame:
    """Windows that an earlier document holds, of q-grams with too many units: a minimum for each window, then a join that Spark can split."""
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in ("w1", "w2", "doc_id", "t1", "t2")), T.StructField("start", T.IntegerType())])
    other, powers = table(93), Powers(94)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, which, start, count, _, texts in _units(batches, s["length"], s["chunk"] // 32):
            start, count = start.astype(np.int64), count.astype(np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            begins = np.concatenate([[0], np.cumsum(count + s["length"] - 1)])[:-1]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(begins, count) + within
            hashes = [stretch(prefix(t[data], p), at, at + s["length"], p) for t, p in ((_BYTE, _POWERS), (other, powers))]
            key = keys[np.repeat(which, count)].view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), *(pa.array(np.ascontiguousarray(key[:, i])) for i in range(3)), pa.array((np.repeat(start, count) + within).astype(np.int32))], names=schema.names)
        give_back()

    rows = asked.mapInArrow(run, schema)
    least = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    found = rows.join(least, ["w1", "w2"]).filter("doc_id > least")
    return found.select("doc_id", "t1", "t2", F.struct("start").alias("s")).groupBy("doc_id", "t1", "t2").agg(F.collect_set("s.start").alias("alone"))


def repeated_windows(docs: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, refined_bytes: int = REFINED_BYTES, chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, t1, t2, and of each such document `stretches` and `alone`: runs of windows, and single ones, of `length` bytes that start in a document with a smaller doc_id too.

    `docs` has doc_id (long, no nulls), t1, t2 (hashes of the text) and text; `packed` the same with the text's bytes.
    """
    s = {"length": length, "gram": gram, "chunk": chunk, "hot_rows": hot_rows, "refined_bytes": refined_bytes}
    key = ["doc_id", "t1", "t2"]
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = context.broadcast(_hot_grams(docs, size, s) if size > hot_rows else np.zeros(0, dtype=U64))  # fewer bytes can't hold that many
    units = materialise(_whole_units(docs, max(1, -(-size // bucket_bytes)), hot, s), "units")
    found = units.filter(F.col("asks") == FOUND).select(*key, "stretches")
    sizes = {r.asks: r.n for r in units.groupBy("asks").agg(F.sum(F.octet_length("stretches")).alias("n")).collect()}  # three rows
    if NARROW in sizes:
        # a unit has some 60 bytes
        buckets = -(-sizes[NARROW] // _STRETCH.itemsize * 5 * length // (4 * DEALT * refined_bytes))
        found = found.unionByName(_parts_of_units(_asked(units.filter(F.col("asks") == NARROW), packed), buckets, s).select(*key, "stretches"))
    runs = found.groupBy(*key).agg(F.collect_list("stretches").alias("stretches"))
    if WIDE not in sizes:
        return runs.withColumn("alone", F.lit(None).cast("array<int>"))
    return runs.join(_wide_windows(_asked(units.filter(F.col("asks") == WIDE), packed), s), key, "full")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with doc_id as long (null: the smallest), and t1 and t2, which with it tell rows with different texts apart: 128 bits of hash where a
    doc_id has several texts, and 0 where it has one, which most have."""
    rows = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    spread = rows.select("doc_id", *(h.alias(t) for t, h in hashes.items())).groupBy("doc_id").agg(*(f(t).alias(f"{n}_{t}") for t in hashes for n, f in (("least", F.min), ("most", F.max))))
    several = materialise(spread.filter("least_t1 != most_t1 OR least_t2 != most_t2").select("doc_id", F.lit(True).alias("_several")), "ids")
    n = several.count()
    if n == 0:
        return rows.withColumns(dict.fromkeys(hashes, F.lit(0).cast("long")))
    joined = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    return joined.withColumns({t: F.when(F.col("_several"), h).otherwise(F.lit(0)) for t, h in hashes.items()}).drop("_several")


def cut_windows(docs: DataFrame, length: int) -> DataFrame:
    """`docs` (with packed, stretches and alone) with kept, n_bytes, n_removed, n_spans and spans instead."""
    kept_columns = [c for c in docs.columns if c not in ("packed", "stretches", "alone")]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = T.StructType([*(docs.schema[c] for c in kept_columns), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                packed, stretches, alone = (batch.column(batch.schema.get_field_index(c)) for c in ("packed", "stretches", "alone"))
                data, offsets = as_bytes(packed)
                of, row = _stretches(stretches)
                a, n = offsets[row] + of["start"], of["count"].astype(np.int64)
                if alone.null_count < batch.num_rows:
                    more = pc.fill_null(pc.list_value_length(alone), 0).to_numpy(zero_copy_only=False)
                    row = np.concatenate([row, np.repeat(np.arange(batch.num_rows), more)])
                    a = np.concatenate([a, offsets[row[len(a) :]] + alone.flatten().to_numpy()])
                    n = np.concatenate([n, np.ones(len(a) - len(n), dtype=np.int64)])
                order = np.argsort(a, kind="stable")
                row, a, b = row[order], a[order], np.maximum.accumulate((a + n - 1 + length)[order])
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] > b[:-1]) | (row[1:] != row[:-1])
                row, begin, end = row[new], a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)] if len(a) else b
                # one more inside of a span; one can begin where one of the text before ends
                inside = np.zeros(len(data) + 1, dtype=np.int8)
                inside[begin] += 1
                inside[end] -= 1
                kept = data[np.cumsum(inside[:-1], dtype=np.int8) == 0]
                sizes, n_spans = np.diff(offsets), np.bincount(row, minlength=batch.num_rows)
                n_removed = np.diff(np.concatenate([[0], np.cumsum(end - begin)])[np.concatenate([[0], np.cumsum(n_spans)])])
                ends = np.concatenate([[0], np.cumsum(sizes - n_removed)]).astype(np.int32)
                pair = pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)) for c in kept_columns),
                        pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(kept)]),
                        *(pa.array(x.astype(np.int64)) for x in (sizes, n_removed, n_spans)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), pair),
                    ],
                    names=schema.names,
                )
        give_back()

    return docs.mapInArrow(run, schema)


def drop_substrings(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """`docs` with kept (binary: the bytes that stay, end to end), n_bytes, n_removed, n_spans and spans (byte ranges in the original text) instead of text.

    A string counts as repeated if it starts in a document with a smaller doc_id, judged on the
    input. Null texts count as empty, null doc_ids as the smallest; rows with equal doc_id don't
    remove from each other, whether their texts are equal or not; texts shorter than `length` stay whole; a
    text of any length is looked through in pieces of `BLOCK` bytes, though Python holds it as one while it is
    cut; an empty table gives no rows. Columns with the names of new ones, or named t1, t2, packed, stretches
    or alone, are replaced.
    """
    key = ["doc_id", "t1", "t2"]
    source = keyed(docs.drop("kept", "n_bytes", "n_removed", "n_spans", "spans", "t1", "t2", "packed", "stretches", "alone"))
    packed = source.withColumn("packed", F.col("text").cast("binary")).drop("text")
    found = repeated_windows(source.select(*key, "text"), packed, length, **how)
    joined = packed.join(found, key, "left")
    return cut_windows(joined, length).drop("t1", "t2").withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
