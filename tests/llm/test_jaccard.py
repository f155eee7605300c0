"""Components of the near-duplicate join against all pairs in plain Python."""

import random
import re

from relaywright.llm.jaccard import near_duplicates


def shingles(text, size):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, share):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    for a in range(len(sets)):
        for b in {k for x in sets[a][1] for k in by[x] if k > a}:
            common = len(sets[a][1] & sets[b][1])
            if share[1] * common >= share[0] * (len(sets[a][1]) + len(sets[b][1]) - common):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i if i is not None else -1), len(s), (low.get(find(k), -1) if s else (i if i is not None else -1))) for k, (i, s) in enumerate(sets))


def make():
    r = random.Random(8)
    word = lambda: f"W{r.randrange(4000)}"
    line = " ".join(word() for _ in range(30))
    rows, i = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "é b"), (None, "a b")], 10
    for _ in range(12):
        base = [word() for _ in range(r.choice([12, 40, 150, 300]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 30)):
                copy[r.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy) + ("\n" + line if r.random() < 0.5 else "")))
            i += 1
    # a chain: each a near copy of the one before it only
    chain = [word() for _ in range(120)]
    for _ in range(12):
        at = r.randrange(len(chain))
        chain = list(chain)
        chain[at] = word()
        rows.append((i, " ".join(chain)))
        i += 1
    r.shuffle(rows)
    return rows


def check(spark, rows, size, share, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in near_duplicates(docs, size, share, **more).collect())
    assert got == brute(rows, size, share)


def test_components_match_all_pairs(spark):
    rows = make()
    check(spark, rows, 4, (85, 100))
    check(spark, rows, 5, (80, 100), limit=3, most=50, probes=2)
    check(spark, rows, 4, (85, 100), limit=2, shared=1, block=3)


def test_class_numbers_that_clash(spark):
    check(spark, make(), 4, (85, 100), width=5)


def test_documents_match_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 4, (85, 100))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(3, "one two three four five six"), (3, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    assert near_duplicates(docs.limit(0)).count() == 0
    assert [r.component_id for r in near_duplicates(docs).collect()] == [2, 2, 2]


def test_nested_copies_match_all_pairs(spark):
    """Truncated copies whose lists are led by a larger one that can link with the next size only."""
    r = random.Random(3)
    rows = []
    for sizes in [(103, 89, 87)] * 60 + [(103, 89, 77, 68)] * 60:
        base = [f"n{r.randrange(10**9)}" for _ in range(sizes[0])]
        rows += [(len(rows) + k, " ".join(base[:n])) for k, n in enumerate(sizes)]
    check(spark, rows, 4, (85, 100))
    check(spark, rows, 4, (85, 100), limit=2, shared=1, block=3)
