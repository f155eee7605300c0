"""Repeated substrings against a dictionary of all windows in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from relaywright.llm import substrings
from relaywright.llm.substrings import LENGTH, drop_substrings


def brute(rows, length=LENGTH):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            d = -(2**63) if doc_id is None else doc_id
            first[w] = min(first.get(w, d), d)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (-(2**63) if doc_id is None else doc_id):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id if doc_id is not None else -1, len(raw), sum(gone), spans, kept))
    return sorted(out)


def make():
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "été", *(f"w{r.randrange(80)}x" for _ in range(6))])
    passages = [" ".join(word() for _ in range(r.choice([8, 12, 14, 30]))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 49), (4, "a" * 50), (5, "a" * 200), (6, "ab" * 100), (None, passages[0] + passages[1])]
    for i in range(10, 130):
        parts = []
        for _ in range(r.choice([1, 3, 6])):
            parts.append(" ".join(word() for _ in range(r.choice([3, 20, 40]))))
            p = r.choice(passages)
            cut = r.choice([0, 5, 20])
            parts.append(p[cut : len(p) - r.choice([0, 7])])
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    rows += [(200 + i, rows[20][1]) for i in range(9)] + [(15, "another text with an id that is taken, " + passages[3])]
    for i in range(40):  # near copies
        text = list(rows[30][1])
        for _ in range(4):
            text[r.randrange(len(text))] = "Q"
        rows.append((300 + i, "".join(text)))
    r.shuffle(rows)
    return rows


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, t1 int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_substrings(docs, **how).collect())
    assert got == brute(rows)


SMALL = {"chunk": 64, "bucket_bytes": 3000, "refined_bytes": 2000}


@pytest.mark.parametrize("how", [{}, SMALL, {"chunk": 500, "hot_rows": 10, "bucket_bytes": 5000}, {"hot_rows": 1}])
def test_cuts_match_all_windows(spark, how):
    check(spark, make(), **how)


def test_documents_match_all_windows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_substrings(docs).collect())
    assert got == brute(rows)


def test_many_rows_of_one_id(spark):
    """Each of them has its own passages of the document before."""
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, text)]
    for k in range(1500):
        at = r.randrange(3900)
        rows.append((2, f"row {k} " + text[at : at + r.choice([30, 55, 80])] + f" end {k}"))
    rows += [(None, rows[3][1]), (None, rows[4][1]), (2, rows[5][1])]
    check(spark, rows)
    check(spark, rows, **SMALL)


@pytest.mark.parametrize("how", [{}, {"hot_rows": 1000}])
def test_very_long_texts(spark, monkeypatch, how):
    """Longer than the block that is looked through at once, so a repeat lies over the border of two pieces."""
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    r = random.Random(9)
    long = "".join(r.choice("abcdefghij ") for _ in range(12_000))
    rows = [(5, long), (6, "x" + long[900:1100] + "y" + long[3980:4100]), (7, "z" * 7 + long), (8, "a" * 5000), (9, "a" * 3001), (10, long[:999])]
    want = brute(rows)

    def windows(size):
        substrings.BLOCK = size
        chunk = substrings.Chunk(50, 16)
        column = pa.array([t for _, t in rows])
        keys = np.array([[i, i, i] for i, _ in rows], dtype=np.uint64)
        for i, j, base, data, offsets in substrings._pieces(column, 50):
            chunk.add(keys[i:j], data, offsets, base)
        c = chunk.take()
        return sorted((int(w), s + k) for w, s, n in zip(c["which"], c["start"].tolist(), c["count"].tolist(), strict=True) for k in range(n))

    whole, pieces = windows(1 << 19), windows(1000)
    texts = [t for _, t in rows]
    assert [x[1] for x in whole] and len(whole) == sum(max(0, len(t) - 49) for t in texts) == len(pieces)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in drop_substrings(docs, **how).collect())
    assert got == want


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (1, "x" * 60)], "doc_id long, text string")
    assert drop_substrings(docs.limit(0)).count() == 0
    assert [r.n_removed for r in drop_substrings(docs).collect()] == [0, 0]
    copies = spark.createDataFrame([(1, "y" * 100)] + [(2, "w " + "y" * 100)] * 40, "doc_id long, text string").repartition(4)
    assert sorted(r.n_removed for r in drop_substrings(copies).collect()) == [0] + [100] * 40


def test_few_units_share_a_gram_by_chance(spark):
    """Texts of few syllables, without repeats of 50 bytes: what is asked for and refined must not grow faster than the table."""
    r = random.Random(11)
    docs = spark.createDataFrame([(i, "".join(r.choice(["ta", "ne", "oi", "su"]) for _ in range(1000))) for i in range(300)], "doc_id long, text string")
    s = {"length": substrings.LENGTH, "gram": substrings.GRAM, "chunk": substrings.CHUNK, "hot_rows": substrings.HOT_ROWS, "refined_bytes": substrings.REFINED_BYTES}
    hot = spark.sparkContext.broadcast(np.zeros(0, dtype=np.uint64))
    units = substrings._whole_units(substrings.keyed(docs).select("doc_id", "t1", "t2", "text"), 1, hot, s)
    asked = sum(len(x.stretches) // substrings._STRETCH.itemsize for x in units.filter(f"asks != {substrings.FOUND}").collect())
    assert asked < 0.05 * 600_000 / 20  # an anchor in 20 bytes at most
    assert [x.n_removed for x in drop_substrings(docs).collect()] == [0] * 300


def test_values_that_share_the_bits_sorted_on(monkeypatch):
    """Rows are sorted on the high bits of hashes; different values that share them are told apart."""
    r = np.random.default_rng(5)
    gram = r.integers(0, 4, 500).astype(np.uint64) << np.uint64(62) | r.integers(0, 3, 500).astype(np.uint64)
    unit, doc = r.integers(0, 4, 500).astype(np.uint64), r.integers(-3, 3, 500)
    order = substrings.ordered(gram, unit, doc)
    rows = list(zip(gram.tolist(), unit.tolist(), doc.tolist(), strict=True))
    assert [rows[i] for i in order] == sorted(rows)
    monkeypatch.setattr(substrings, "mix", lambda x: np.zeros_like(x))
    for values in ((gram,), (unit, gram), (r.integers(0, 9, 500).astype(np.uint64),)):
        number, alone = substrings._number(*values)
        rows = list(zip(*(v.tolist() for v in values), strict=True))
        assert len(set(zip(rows, number.tolist(), strict=True))) == len(set(rows)) == len(set(number.tolist()))
        assert [rows.count(x) == 1 for x in rows] == alone.tolist()
    number, alone = substrings._number(np.zeros(0, dtype=np.uint64))
    assert len(number) == len(alone) == 0


def test_spans_side_by_side(spark):
    """Texts that are removed up to their end, beside ones that are removed from their start, in one batch."""
    r = random.Random(12)
    p, q = ("".join(r.choice("abcdefghij ") for _ in range(80)) for _ in range(2))
    rows = [(1, p + "-" + q), (2, "x" * 9 + p), (3, q), (4, p + q), (5, None), (6, p + "y" + q + "zz"), (7, q), (8, "é" + q + "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in drop_substrings(docs).collect())
    assert got == brute(rows)
    raw = {i: (t or "").encode() for i, t in rows}
    for x in drop_substrings(docs).collect():
        assert b"".join(raw[x.doc_id][a:b] for a, b in zip([0, *(s.end for s in x.spans)], [*(s.start for s in x.spans), x.n_bytes], strict=True)) == bytes(x.kept)
