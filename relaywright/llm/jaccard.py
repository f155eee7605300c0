"""Near-duplicate join on word shingles: exact Jaccard links by T-occurrence search, and their components.

Texts with equal shingle sets are one class from the start. Two classes of n and m shingles link
only if they share T = ceil(0.85 (n + m) / 1.85) or more: the T-occurrence problem over inverted lists.
As in DivideSkip the lists of a class are divided: the T - K longest are set aside, and as a partner must
be on K of the n - T + K others, the short lists, only those are merged, and what occurs on K is a
candidate. The long ones are only probed, by binary search in the candidate's sorted set.

* Order: shingles of long lists come last, others by hash. Any order that holds for all texts gives the
  same links; this one puts what is a class's own first and keeps what thousands share off the
  short lists. Lists are counted over all texts; what a task sees once adds nothing to the count.
* Merge: the short lists meet in one shuffle, sorted within each partition, and are read as a stream.
  A list names as leader the class where the shingle ranks first, which has the fewest rare ones, and
  others only where sizes rule the leader out. Each class is tried with its most frequent leader.
  A class that an earlier leader's size rules out, but not the sizes of what that one may lead, is named
  with it as well, so that any two classes of a list that can link share a leader: three pairs an
  entry at most, whatever the length of the list.
* Probe: a leader's set meets its candidates' texts; leaders with many are dealt out with a salt.
* The rest: links give components. Lists that still hold classes of different components are open; a
  class with fewer than K entries on open lists is done. The classes that a leader's open lists name meet
  in blocks of bounded size, and each block is searched for links that join components: a heap merges a set's
  short lists, and its others are probed.
  Only those are put out, fewer than there are classes; no pair is a row before it is a link.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import U64, Powers, blocks, give_back, lower_ascii, mix, owner, prefix, stretch, table, words
from relaywright.llm.components import components
from relaywright.llm.runtime import materialise

#: A list of more entries than this is long, and at most so many shingles are known as long: the limit is doubled until they fit.
LONG_LIST, LONG_LISTS = 64, 1_000_000
#: Short lists that a pair must share (K); all that it needs for sets that are smaller.
SHARED = 8
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Candidates of a leader that one task probes.
PROBES = 2_000
#: Classes in a block that is searched at once, and their shingles, on average.
BLOCK, BLOCK_SHINGLES = 1_024, 1_000_000

#: Salt of the second hash of a set.
SECOND = 0x2545F491
#: First hashes of a set that different sets share, at most: of 10**11 classes about 300 are expected.
CLASHES = 100_000

_BYTE, _BYTES, _WORDS = table(71, lower_ascii), Powers(72), Powers(73)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block in order, end to end, and where each text's begin."""
    n = len(offsets) - 1
    starts, ends = words(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=U64), np.zeros(n + 1, dtype=np.int64)
    word = stretch(prefix(_BYTE[data], _BYTES), starts, ends, _BYTES)
    text = owner(offsets, starts)
    sums = prefix(word, _WORDS)
    first = np.searchsorted(text, np.arange(n + 1))
    count = np.diff(first)
    # shingles start at all words but the last size - 1; a shorter text is one shingle
    begin = np.flatnonzero(np.arange(len(word)) + size <= first[text + 1])
    short = np.flatnonzero((count > 0) & (count < size))
    hashes = np.concatenate([stretch(sums, begin, begin + size, _WORDS), stretch(sums, first[short], first[short + 1], _WORDS)])
    of = np.concatenate([text[begin], short])
    if len(short):
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
    sets, at = [], [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        one = np.sort(hashes[i:j])
        if j > i + 1:
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        sets.append(one)
        at.append(at[-1] + len(one))
    return np.concatenate(sets), np.array(at)


def set_hashes(sets: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A number for each set, from the sum of its mixed members and their count; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(sets ^ U64(salt)), dtype=U64)])
    count = np.diff(at).astype(U64)
    return np.where(count > 0, mix(sums[at[1:]] - sums[at[:-1]] + count * U64(0x9E3779B1)), U64(0))


def class_ids(sets: np.ndarray, at: np.ndarray, clashes: np.ndarray, width: int = 64) -> np.ndarray:
    """The class of each set: its first hash, cut to `width` bits, or the second where different sets share the first."""
    ids = set_hashes(sets, at, 0x5BD1E995)
    if width < 64:
        ids = np.where(ids > 0, ids % U64(1 << width) + U64(1), ids)
    ids = ids.view(np.int64)
    if len(clashes):
        ids = np.where(np.isin(ids, clashes), set_hashes(sets, at, SECOND).view(np.int64), ids)
    return ids


def needed(n, share: tuple[int, int]):
    """Shingles that a partner of a set of n shares at least."""
    return -(-share[0] * n // share[1])


def short_lists(sets: np.ndarray, at: np.ndarray, share: tuple[int, int], long: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles whose lists are short, n - T + K of each set in the global order, their texts and their ranks. `long`: the sorted shingles on long lists."""
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    least = needed(count, share)
    take = count - least + np.minimum(shared, least)
    rank = np.arange(len(sets)) - at[text]
    if len(long) and len(sets):
        there = np.searchsorted(long, sets)
        last = long[np.minimum(there, len(long) - 1)] == sets
        before = np.concatenate([[0], np.cumsum(last)])
        # the others keep their order, the long ones follow them in theirs
        others = count - (before[at[1:]] - before[at[:-1]])
        on_long = before[:-1] - before[at[:-1]][text]
        rank = np.where(last, others[text] + on_long, rank - on_long)
    some = rank < take[text]
    return sets[some], text[some], rank[some]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Binary probes of the smaller set's members in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    there = np.searchsorted(b, a)
    return int((b[np.minimum(there, len(b) - 1)] == a).sum())


def _members(docs: DataFrame, size: int, ids: Callable) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("row", "doc_id", "node", "second", "n_shingles")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(2)):
                sets, at = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(ids(sets, at)), pa.array(set_hashes(sets, at, SECOND).view(np.int64)), pa.array(np.diff(at))], names=schema.names)
        give_back()

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _clashes(members: DataFrame) -> np.ndarray:
    """Class numbers that sets with different second hashes share: the square of the number of classes over 2**65 are expected."""
    seconds = members.groupBy("node").agg(F.min("second").alias("least"), F.max("second").alias("most"))
    found = seconds.filter("least != most").select("node").limit(CLASHES + 1).toArrow()["node"].to_numpy()
    if len(found) > CLASHES:
        raise ValueError(f"over {CLASHES} class numbers are shared")
    return found


def _entries(docs: DataFrame, size: int, ids: Callable, share: tuple[int, int], long, shared: int) -> DataFrame:
    """shingle, node, n and rank of each entry on a short list; each task enters a class once."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                sets, at = shingle_sets(data, offsets, size)
                node = ids(sets, at)
                fresh = np.zeros(len(node), dtype=bool)
                for k, x in enumerate(node.tolist()):
                    if x and x not in entered:
                        entered.add(x)
                        fresh[k] = True
                shingle, text, rank = short_lists(sets, at, share, long.value, shared)
                some = fresh[text]
                shingle, text, rank = shingle[some], text[some], rank[some]
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(node[text]), pa.array(np.diff(at)[text].astype(np.int32)), pa.array(rank.astype(np.int32))], names=schema.names)
        give_back()

    return docs.select("text").mapInArrow(run, schema)


def _long_shingles(docs: DataFrame, size: int, ids: Callable, limit: int, most: int) -> np.ndarray:
    """The shingles that are counted in more than `limit` classes; the most frequent, if they are over `most`."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered: set[int] = set()
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                sets, at = shingle_sets(data, offsets, size)
                for k, x in enumerate(ids(sets, at).tolist()):
                    if x not in entered:
                        entered.add(x)
                        parts.append(sets[at[k] : at[k + 1]])
                        held += len(parts[-1])
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)
        del parts, entered
        give_back()

    counts = docs.select("text").mapInArrow(run, schema).groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    counts = materialise(counts, "lists")
    by_power = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2(F.col("n") / limit)).cast("int")).count().collect()}  # 64 rows at most
    power, total = max(by_power, default=0) + 1, 0
    while power > 0 and total + by_power.get(power - 1, 0) <= most:
        power -= 1
        total += by_power.get(power, 0)
    found = counts.filter(F.col("n") >= limit * 2.0**power).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.view(U64))


def compatible(n: int, m: int, share: tuple[int, int]) -> bool:
    return share[1] * min(n, m) >= share[0] * max(n, m)


def near(n: int, m: int, share: tuple[int, int]) -> bool:
    """Can a set of a size between be compatible with both?"""
    return share[1] ** 2 * min(n, m) >= share[0] ** 2 * max(n, m)


def _led(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """shingle, node, n, leader, beside: entries of the lists with two classes or more, read as a sorted stream; a leader's own entry names itself.

    Two compatible classes X and Y of a list share a leader: if X's is named before Y's, it is near to Y, and
    Y has an entry `beside` with it.
    """
    schema = T.StructType([*(entries.schema[k] for k in ("shingle", "node", "n")), T.StructField("leader", T.LongType()), T.StructField("beside", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders, waiting, seen = None, [], None, None
        for batch in batches:
            shingle, node, n = (batch.column(i).to_numpy() for i in range(3))
            same = np.zeros(len(shingle), dtype=bool)  # an entry that shares its list with the one before or after
            same[1:] |= shingle[1:] == shingle[:-1]
            same[:-1] |= shingle[1:] == shingle[:-1]
            if len(shingle):
                same[[0, -1]] = True
            out: list[tuple[int, ...]] = []
            at = np.flatnonzero(same)
            for s, x, m in zip(*(c[at].tolist() for c in (shingle, node, n)), strict=True):
                if s != current:
                    current, leaders, waiting, seen = s, [(x, m)], (s, x, m, x, False), x
                    continue
                if x == seen:
                    continue  # equal entries of several tasks stand together
                seen = x
                if waiting:
                    out.append(waiting)
                    waiting = None
                for y, k in leaders:
                    if compatible(m, k, share):
                        out.append((s, x, m, y, False))
                        break
                    if near(m, k, share):
                        out.append((s, x, m, y, True))
                else:
                    leaders.append((x, m))
                    out.append((s, x, m, x, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names=schema.names)
        give_back()

    central = F.floor(F.col("rank") * 1000 / F.col("n"))
    ordered = entries.repartition("shingle").sortWithinPartitions("shingle", central, "node")
    return ordered.mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """row and the text as a zlib stream, which is what gets shuffled."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                packed = [zlib.compress(data[a:b], 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, type=pa.binary())], names=schema.names)
        give_back()

    return docs.select("row", "text").mapInArrow(run, schema)


def _sets_of(packed: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [zlib.decompress(x.as_py()) for x in packed]
    return shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), size)


def linked(n: int, m: int, common: int, share: tuple[int, int]) -> bool:
    return share[1] * common >= share[0] * (n + m - common)


def _links(pairs: DataFrame, chosen: DataFrame, docs: DataFrame, size: int, ids: Callable, share: tuple[int, int], probes: int) -> DataFrame:
    """The pairs (u, v) whose sets overlap enough; `chosen` names a row of `docs` for each node."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / probes).cast("int").alias("salts"))
    leaders = salts.select("u", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("later"))
    others = pairs.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("later"))
    wanted = leaders.unionByName(others).join(chosen.withColumnRenamed("node", "v"), "v")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, members = None, None
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            out = []
            for i in range(0, len(u), 256):
                sets, at = _sets_of(batch.column(2).slice(i, 256), size)
                node = ids(sets, at)
                for k in range(len(at) - 1):
                    own, a, b = sets[at[k] : at[k + 1]], int(u[i + k]), int(v[i + k])
                    if b != node[k]:
                        continue  # a text of another class whose row has the same number
                    if a == b:
                        leader, members = a, own.copy()
                    elif a == leader and linked(len(own), len(members), overlap(own, members), share):
                        out.append((a, b))
            if out:
                a, b = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])
        give_back()

    dealt = _packed(docs).join(wanted, "row").repartition("u", "salt").sortWithinPartitions("u", "salt", "later", "v")
    return materialise(dealt.select("u", "v", "packed").mapInArrow(run, schema).distinct(), "found")


class Forest:
    """Union-find over a block's components."""

    def __init__(self, parts: np.ndarray):
        _, self.of = np.unique(parts, return_inverse=True)
        self.up = np.arange(self.of.max() + 1)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[self.of]

    def _root(self, a: int) -> int:
        x = self.up[self.of[a]]
        while self.up[x] != x:
            x = self.up[x]
        return x

    def apart(self, a: int, b: int) -> bool:
        return self._root(a) != self._root(b)

    def join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        self.up[max(x, y)] = min(x, y)


def search_block(sets: np.ndarray, at: np.ndarray, parts: np.ndarray, first: np.ndarray, same: bool, share: tuple[int, int], long: np.ndarray, shared: int) -> list[tuple[int, int]]:
    """Links that join components, between the sets of `first` and the others, or among all if it is one block.

    For each set the block's lists of its short shingles are merged by a heap, which counts them exactly in each
    candidate; the shingles set aside are probed in what the count leaves possible, and both together are the overlap.
    """
    n = np.diff(at)
    token, owner_of, _ = short_lists(sets, at, share, long, shared)
    mine = np.searchsorted(owner_of, np.arange(len(n) + 1))
    order = np.argsort(sets, kind="stable")
    lists, on = sets[order], np.repeat(np.arange(len(n)), n)[order]
    forest, out = Forest(parts), []
    roots = forest.roots()
    for q in range(len(n)):
        if not same and not first[q]:
            continue
        # what is in q's component, or too large or too small, leaves the lists before the merge
        wanted = (roots != roots[q]) & (share[1] * np.minimum(n, n[q]) >= share[0] * np.maximum(n, n[q]))
        wanted &= (np.arange(len(n)) > q) if same else ~first
        if not wanted.any():
            continue
        short = token[mine[q] : mine[q + 1]]
        low, high = (np.searchsorted(lists, short, side=s) for s in ("left", "right"))
        to = np.cumsum(high - low)
        entries = on[np.repeat(high - to, high - low) + np.arange(to[-1])]
        some = wanted[entries]
        entries, to = entries[some].tolist(), np.cumsum(some)[to - 1].tolist()
        merged = np.fromiter(merge(*(entries[i:j] for i, j in zip([0, *to], to) if i < j)), dtype=np.int64, count=len(entries))
        found, count = np.unique(merged, return_counts=True)
        own = sets[at[q] : at[q + 1]]
        aside = np.setdiff1d(own, short, assume_unique=True)
        total = needed((n[q] + n[found]) * share[0], (1, share[0] + share[1]))  # T of the pair
        some = count >= total - len(aside)
        joined = False
        for x, c in zip(found[some].tolist(), count[some].tolist(), strict=True):
            if forest.apart(q, x) and linked(n[q], n[x], c + overlap(aside, sets[at[x] : at[x + 1]]), share):
                forest.join(q, x)
                out.append((q, x))
                joined = True
        if joined:
            roots = forest.roots()
    return out


def _joining(lists: DataFrame, roots: DataFrame, chosen: DataFrame, docs: DataFrame, size: int, ids: Callable, share: tuple[int, int], long, shared: int, block: int) -> DataFrame:
    """Links between classes that share short lists but no component yet, as many as it takes to join their components."""
    rows = lists.select("shingle", "node", "n", "leader", "beside").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    enough = F.least(F.lit(shared), F.ceil(F.col("n") * share[0] / share[1]))
    for k in range(2):
        # lists of one component are done, and so are classes with too few lists
        mixed = rows.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most").select("shingle")
        rows = rows.join(mixed, "shingle", "left_semi")
        many = rows.filter("NOT beside").groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter(F.col("c") >= enough).select("node")
        rows = materialise(rows.join(many, "node", "left_semi"), f"open-lists-{k}")
    groups = rows.groupBy("leader", "node").agg(F.first("part").alias("part"), F.first("n").alias("n"))
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("held"), F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most")
    sizes = sizes.select("leader", F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "leader").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every block of a leader's classes meets every other, and itself
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leader", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "part").join(chosen, "node")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        new = np.append(True, node[1:] != node[:-1])  # a row of the table that is repeated gives a class twice
        kept = np.flatnonzero(new)
        sets, at = _sets_of(table.column("packed").combine_chunks().take(pa.array(kept)), size)
        if (ids(sets, at) != node[kept]).any():  # a text of another class whose row has the same number: look for the right one
            sets, at = _sets_of(table.column("packed").combine_chunks(), size)
            kept = np.flatnonzero(ids(sets, at) == node)
            kept = kept[np.append(True, node[kept][1:] != node[kept][:-1])]
            sets, at = _sets_of(table.column("packed").combine_chunks().take(pa.array(kept)), size)
        first = table.column("own").to_numpy()[kept] == a
        pairs = search_block(sets, at, part[kept], first, a == b, share, long.value, shared)
        u, v = (node[kept][np.array(x, dtype=np.int64)] for x in (zip(*pairs, strict=True) if pairs else ([], [])))
        give_back()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    texts = _packed(docs).join(dealt, "row").select("leader", "a", "b", "own", "node", "part", "packed")
    return materialise(texts.groupBy("leader", "a", "b").applyInArrow(meet, schema), "joining")


def near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), limit: int = LONG_LIST, most: int = LONG_LISTS, probes: int = PROBES, shared: int = SHARED, block: int = BLOCK, width: int = 64) -> DataFrame:
    """row, doc_id, n_shingles, component_id and component of each row of `docs` (doc_id, text).

    Words are runs of bytes that aren't ASCII white space, in ASCII lower case; a shingle is `size` of
    them, or all of a text with fewer. Two texts link if share[1] * intersection >= share[0] * union;
    component_id is the smallest doc_id that links lead to. Texts without words (null, empty) link
    with nothing. Null doc_ids have no say in component_id, which is null only for components of
    such rows; component is a number of the component itself. Rows that repeat are of one class. `row` with doc_id
    tells rows with different texts apart. Classes are numbered by `width` bits of a hash of their set, and by a second hash
    where those of different sets are equal. An empty table gives no rows; texts of any length are taken whole; other
    columns are not read, whatever their names.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    ids = partial(class_ids, clashes=np.zeros(0, dtype=np.int64), width=width)
    members = materialise(_members(source, size, ids), "members")
    clashes = _clashes(members)
    if len(clashes):
        ids = partial(class_ids, clashes=clashes, width=width)
        members = materialise(_members(source, size, ids), "members")
    long = docs.sparkSession.sparkContext.broadcast(_long_shingles(source, size, ids, limit, most))
    lists = materialise(_led(_entries(source, size, ids, share, long, shared), share), "short-lists")
    sizes = lists.filter("leader = node").select(F.col("node").alias("u"), F.col("n").alias("n_u")).distinct()
    enough = F.least(F.lit(shared), F.ceil(F.least("n_u", "n_v") * share[0] / share[1]))

    # one row for each class: any of its documents
    chosen = members.filter("node != 0").groupBy("node").agg(F.min("row").alias("row"))
    counted = lists.filter("leader != node AND NOT beside").groupBy(F.col("leader").alias("u"), F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n_v"))
    led = counted.join(sizes, "u").filter(F.col("c") >= enough)
    pairs = led.groupBy("v").agg(F.max(F.struct("c", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")
    found = _links(pairs, chosen, source, size, ids, share, probes)

    more = _joining(lists, components(found), chosen, source, size, ids, share, long, shared, block)
    roots = components(found.unionByName(more))

    classes = members.groupBy("node").agg(F.min("doc_id").alias("least"))
    parts = classes.filter("node != 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = parts.join(least, "root").select("node", F.col("root").alias("component"), "component_id")
    none = F.col("node") == 0
    labelled = members.join(labels, "node", "left")
    return labelled.select("row", "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(none, F.col("row")).otherwise(F.col("component")).alias("component"))
