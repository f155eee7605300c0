"""Neighbours against all cosines, and recall on the table."""

import numpy as np
import pandas as pd
from relaywright.llm.neighbours import nearest


def brute(rows, every, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every:
            continue
        score = sorted((-(float((w * v).sum()) / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for j, w in good if j != i and len(w) == len(v))
        out[i] = [(j, -s) for s, j in score[:k]]
    return out


def test_recall_on_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 10, 5)
    got = nearest(table, every=10, block=200).collect()
    assert {r.query_id for r in got} == set(want) and len(got) == 5 * len(want)
    exact = {(q, j): s for q, found in want.items() for j, s in found}
    hits = [(r.query_id, r.vec_id) for r in got if (r.query_id, r.vec_id) in exact]
    assert len(hits) >= 0.9 * len(exact)
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)
    for q in want:
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0]), (10, [0.0, 1.0, 0.0]), (50, [1.0, 1.0]), (51, [-1.0, 0.0]), (51, [-1.0, 0.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in sorted(nearest(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 9, 50, 51], 50: [9, 0, 1, 2, 51]}
    assert nearest(table.limit(0)).count() == 0
    assert nearest(table.filter("vec_id = 0")).count() == 0


def test_repeated_rows_are_rows(spark):
    rows = [(50, [1.0, 0.0])] * 3 + [(1, [1.0, 0.1])] * 4 + [(2, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.rank, r.vec_id) for r in nearest(table).collect())
    assert got == sorted([(1, 50), (2, 50), (3, 1), (4, 1), (5, 1)] * 3)
    assert sorted((r.rank, r.vec_id) for r in nearest(table, k=9).collect()) == sorted([(1, 50), (2, 50), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2)] * 3)


def test_recall_with_several_blocks(spark):
    """At the shipped size of a block: 40,000 vectors in three of them, in clusters and alone."""
    r = np.random.default_rng(6)
    centres = r.standard_normal((400, 32))
    matrix = np.concatenate([centres[r.integers(0, 400, 30_000)] + 0.5 * r.standard_normal((30_000, 32)), r.standard_normal((10_000, 32))])
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(matrix)), "embedding": list(matrix)})).repartition(6)
    unit = matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]
    got = {}
    for x in nearest(table, every=400).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = 0
    for q in range(0, len(matrix), 400):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 500
