"""Byte-level BPE, encoding and decoding, with a rank queue for the merges of a pre-token.

The parts of all new pre-tokens of a block are a doubly linked list over byte positions, with a
border between pre-tokens that nothing merges over. Each adjacent pair that is a token waits in
the bucket of its rank; a two-level bitmap marks the buckets in use, and find-first-set on it gives
the lowest rank. Its bucket is worked off from the left; if a merge files a pair of lower rank, what is
left of that pre-token waits until that is done. An entry whose pair has changed since it was filed
is stale and skipped. Each merge files two pairs at most, so n bytes take O(n) queue operations,
in one pre-token or in many.

Texts are independent: each task encodes its own rows and keeps a bounded table of pre-tokens
that it has merged before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import BLOCK_BYTES, give_back

#: Bits of a rank that choose inside a word of the lower bitmap.
WORD_BITS = 8
IN_WORD = (1 << WORD_BITS) - 1
BIT = [1 << i for i in range(1 << WORD_BITS)]
#: Pre-tokens kept merged in each Python worker; twice as many, with those of before.
KEPT = 400_000
#: Characters of text up to which its pre-tokens are listed at once.
LISTED_CHARS = 1 << 20


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a decimal rank."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Starts:
    """Ranks of single bytes and of pairs of bytes, by table; -1: no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.singles = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.pairs = np.full(1 << 16, -1, dtype=np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], starts: Starts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the pre-tokens, end to end, and how many each has.

    `buckets` holds the positions of each rank, `words` the lower bitmap's words in use, `top`
    the bitmap of those words. Pre-tokens that are tokens come out of the queue as any other, or as they are.
    """
    starts = starts or Starts(ranks)
    text = b"\0".join([b"", *pieces, b""])  # a border before, between and after
    n = len(text)
    get = ranks.get
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    edge = np.zeros(n, dtype=bool)
    edge[edges] = True
    border = edge.tobytes()
    owner = (np.cumsum(edge) - 1).tolist()
    raw = np.frombuffer(text, dtype=np.uint8)
    ids = np.where(edge, -1, starts.singles[raw])
    whole = np.fromiter((ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
    known = np.repeat(whole >= 0, sizes + 1)  # of every piece and the border before it
    first = starts.pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    first[edge[:-1] | edge[1:] | known] = -1
    ids[:-1][known] = -1
    ids[edges[:-1][whole >= 0] + 1] = whole[whole >= 0]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    filed = [*first.tolist(), -1]  # the rank of the pair that starts here now; -1: none
    places = np.flatnonzero(first >= 0)
    places = places[np.argsort(first[places], kind="stable")]
    found, cuts = np.unique(first[places], return_index=True)
    listed = places.tolist()
    cuts = [*cuts.tolist(), len(listed)]
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for k, rank in enumerate(found.tolist()):
        buckets[rank] = listed[cuts[k] : cuts[k + 1]]
        word = rank >> WORD_BITS
        words[word] = words.get(word, 0) | BIT[rank & IN_WORD]
        top |= BIT[word]
    token = ids.tolist()  # of the part that starts here; -1: none does
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << WORD_BITS) | (low.bit_length() - 1)
        words[word] = bits = bits ^ low
        if not bits:
            top ^= BIT[word]
        waiting = buckets.pop(rank)
        waiting.sort()
        held, holds = [], -1  # of the pre-token that has a lower rank to do first
        for i in waiting:
            if filed[i] != rank:
                continue  # stale
            if owner[i] == holds:
                held.append(i)
                continue
            gone = after[i]
            end = after[gone]
            token[i] = rank
            token[gone] = -1
            filed[gone] = -1
            after[i] = end
            before[end] = i
            left = before[i]
            fresh = -1 if border[end] else get(text[i : after[end]], -1)
            filed[i] = fresh
            if fresh >= 0:
                if fresh in buckets:
                    buckets[fresh].append(i)
                else:
                    buckets[fresh] = [i]
                    word = fresh >> WORD_BITS
                    words[word] = words.get(word, 0) | BIT[fresh & IN_WORD]
                    top |= BIT[word]
                if fresh < rank:
                    holds = owner[i]
            if not border[left]:
                fresh = get(text[left:end], -1)
                if fresh != filed[left]:
                    filed[left] = fresh
                    if fresh >= 0:
                        if fresh in buckets:
                            buckets[fresh].append(left)
                        else:
                            buckets[fresh] = [left]
                            word = fresh >> WORD_BITS
                            words[word] = words.get(word, 0) | BIT[fresh & IN_WORD]
                            top |= BIT[word]
                        if fresh < rank:
                            holds = owner[i]
        if held:
            buckets[rank] = held
            word = rank >> WORD_BITS
            words[word] = words.get(word, 0) | BIT[rank & IN_WORD]
            top |= BIT[word]
    ids = np.array(token, dtype=np.int32)
    left = ids >= 0
    return ids[left], np.bincount(np.cumsum(edge)[left] - 1, minlength=len(pieces))[: len(pieces)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    return merge_all([piece], ranks)[0].tolist()


class Table:
    """Pre-token to its place among runs of ids that stand end to end."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.end = 0

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, end = len(self.place), self.end + len(ids)
        self.ids, self.starts, self.counts = _room(self.ids, end), _room(self.starts, n + len(pieces)), _room(self.counts, n + len(pieces))
        self.ids[self.end : end] = ids
        self.counts[n : n + len(pieces)] = counts
        self.starts[n : n + len(pieces)] = self.end + np.cumsum(counts) - counts
        self.place.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.end = end

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of `places`, end to end, and how many each has."""
        counts = self.counts[places]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[places] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


def _room(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    wider = np.zeros(max(size, 2 * len(x)), x.dtype)
    wider[: len(x)] = x
    return wider


class Merged:
    """Pre-token to ids, merged when first met; what wasn't met lately is dropped."""

    def __init__(self, ranks: dict[bytes, int], pattern):
        self.ranks, self.pattern, self.starts = ranks, pattern, Starts(ranks)
        self.known, self.older = Table(), Table()

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where the pre-tokens stand in `known`, in which all of them are then."""
        look = lambda: np.fromiter(map(self.known.place.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        found = look()
        lacking = np.flatnonzero(found < 0).tolist()
        if not lacking:
            return found
        fresh = list(dict.fromkeys(pieces[k] for k in lacking))
        if len(self.known.place) + len(fresh) > KEPT:
            # the tables change places before the block, so all of it stays known until it is done
            self.older, self.known = self.known, Table()
            fresh, lacking = list(dict.fromkeys(pieces)), None
        before = self.older.place
        moved = [p for p in fresh if p in before]
        if moved:
            self.known.add(moved, *self.older.runs(np.array([before[p] for p in moved])))
        new = [p for p in fresh if p not in before]
        self.known.add(new, *merge_all([p.encode("utf-8") for p in new], self.ranks, self.starts))
        if lacking is None:
            return look()
        place = self.known.place
        found[lacking] = [place[pieces[k]] for k in lacking]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, end to end, and how many each has."""
        find = self.pattern.findall
        ids, counts, i = [], [], 0
        while i < len(texts):
            if len(texts[i]) > LISTED_CHARS:
                ids.append(self._long(texts[i]))
                counts.append([len(ids[-1])])
                i += 1
                continue
            j = i
            pieces, ends = [], [0]
            while j < len(texts) and len(texts[j]) <= LISTED_CHARS:
                pieces += find(texts[j])
                ends.append(len(pieces))
                j += 1
            flat, each = self._ids(pieces)
            ids.append(flat)
            counts.append(np.diff(np.concatenate([[0], np.cumsum(each)])[ends]))
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        places = self.places(pieces)  # may change `known`
        return self.known.runs(places)

    def _long(self, text: str) -> np.ndarray:
        """A text of any length, its pre-tokens some at a time."""
        parts, matches = [], (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(matches, 100_000)):
            parts.append(self._ids(some)[0])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


_WORKER: dict[tuple[int, str], Merged] = {}


def _tools(raw: bytes, pattern: str) -> Merged:
    """Ranks, pattern and table, built once in each Python worker."""
    key = (hash(raw), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Merged(load_ranks(raw), regex.compile(pattern))
    return _WORKER[key]


class Speller:
    """The bytes of ids, by table."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {rank: token for token, rank in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.spelled = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """A binary value for each run of `counts` ids."""
        took = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(took)])
        data = self.spelled[np.repeat(self.starts[ids] - ends[:-1], took) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])


def _coded(docs: DataFrame, ranks_file: str, pattern: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    with open(ranks_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size doesn't grow with the data
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*kept)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType(), False))
    schema = T.StructType([*source.schema.fields, *fields])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _tools(raw.value, pattern)
        speller = Speller(merged.ranks) if decoded else None
        for batch in batches:
            column = batch.column(at).cast(pa.binary())
            for i, j in _runs(column):
                flat, counts = merged.encode([(x.as_py() or b"").decode("utf-8", "replace") for x in column.slice(i, j - i)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists, *([speller.spell(flat, counts)] if speller else [])], names=schema.names)
        merged.older = Table()
        give_back()

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the column `ids`, array<int>: the ids of each text, none for a null text.

    Each match of `pattern` is encoded by itself; text that spells a special token is ordinary
    text. Bytes that aren't UTF-8 count as U+FFFD. `ids` replaces a column of that name.
    """
    return _coded(docs, ranks_file, pattern, text, ids, None)


def encode_and_decode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encode`, and `decoded`: the bytes that the ids give, in the same pass."""
    return _coded(docs, ranks_file, pattern, text, ids, decoded)


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.array([0 if x is None else len(x) for x in (v.as_buffer() if v.is_valid else None for v in column)], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_BYTES, side="right")) - 1)
        yield i, j
        i = j


def decode(df: DataFrame, ranks_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the column `decoded`, binary: the bytes of the ids, one after the other; a null list gives none."""
    with open(ranks_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != decoded]
    source = df.select(*kept)
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.BinaryType(), False)])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(load_ranks(raw.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.column(at).slice(i, 256)
                counts = np.array([len(x) if x.is_valid else 0 for x in part], dtype=np.int64)
                values = speller.spell(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 256).columns, values], names=[*kept, decoded])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal, joined by commas, and of the decoded bytes."""
    coded = encode_and_decode(docs.select("doc_id", "text"), ranks_file, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
