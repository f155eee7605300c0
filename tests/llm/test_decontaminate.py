"""Spaced-seed search against a brute-force scan of all diagonals."""

import random
import re
from itertools import combinations

import pyarrow as pa

from relaywright.llm import decontaminate as D


def norm(text):
    words = [re.sub(rb"[^A-Za-z0-9\x80-\xff]", b"", w).lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    return [w for w in words if w]


def best(pairs):
    low, total, top, at = 0, 0, 0, (0, 0)
    start = 0
    for k, same in enumerate(pairs):
        total += 1 if same else -D.DIFFERENCE
        if total < low:
            low, start = total, k + 1
        if total - low > top:
            top, at = total - low, (start, k + 1)
    return at


def every(pairs, least, base=0):
    """The best stretch, and what is left of it on both sides, if they have enough equal words."""
    if sum(pairs) < least:
        return []
    a, b = best(pairs)
    own = [(base + a, base + b)] if sum(pairs[a:b]) >= least else []
    return every(pairs[:a], least, base) + own + every(pairs[b:], least, base + b)


def brute(docs, items):
    """Pairs with a long stretch on some diagonal that holds a seed."""
    out = set()
    for doc_id, text in docs:
        d = norm(text)
        for item_id, other in items:
            t = norm(other)
            for shift in range(-len(t) + 1, len(d)):
                a, b = max(0, shift), min(len(d), len(t) + shift)
                same = [d[i] == t[i - shift] for i in range(a, b)]
                seeded = any(all(same[i + k] for k, bit in enumerate(m) if bit == "1") for m in D.MASKS for i in range(len(same) - len(m) + 1))
                for x, y in every(same, min(D.MIN_WORDS, len(t))) if seeded else ():
                    out.add((doc_id, item_id, sum(same[x:y])))
    return out


def make():
    r = random.Random(5)
    word = lambda: r.choice(["the", "of", "and", *(f"w{r.randrange(300)}" for _ in range(4))])
    items = [(k, " ".join(word() for _ in range(r.choice([3, 8, 20, 40])))) for k in range(12)]
    docs = [(0, None), (1, ""), (2, "?? !! --"), (3, "the " * 200)]
    for k in range(4, 40):
        body = [word() for _ in range(60)]
        if k % 2:
            leak = r.choice(items)[1].split()
            for i in range(len(leak)):
                if r.random() < 0.08:
                    leak[i] = "changed"
            body[20:20] = [w.upper() + "," for w in leak]
        docs.append((k, " ".join(body)))
    return docs, items


def test_hits_match_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    t = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len({x[0] for x in want}) >= 8
    for part in (D.PART_WORDS, 60):
        got = {(r.doc_id, r.item_id, r.n_agree) for r in D.contaminated(d, t, part).collect()}
        assert got == want
    kept = {r.doc_id for r in D.drop_contaminated(d, t).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}


def test_offsets_and_empty_tables(spark):
    item = "One, two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    text = "été before: " + item.replace("seven", "SEVENTY") + " after"
    d = spark.createDataFrame([(9, text), (9, text)], "doc_id long, text string")
    t = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    rows = D.contaminated(d, t).collect()
    assert len(rows) == 2 and rows[0].n_agree == 13 and rows[0].n_words == 14
    assert text.encode()[rows[0].start : rows[0].end].decode() == item.replace("seven", "SEVENTY")
    assert D.contaminated(d.limit(0), t).count() == 0
    assert D.contaminated(d, t.limit(0)).count() == 0


def test_short_items_with_substitutions_at_every_position():
    for n in range(1, 21):
        item = [f"v{n}x{k}" for k in range(n)]
        known = D.benchmark(pa.array([7]), pa.array([" ".join(item)]), D.SHARE)
        subs = 0 if n < 6 else 1 if n < 8 else 2
        for changed in (c for k in range(subs + 1) for c in combinations(range(n), k)):
            leak = ["other" if k in changed else w for k, w in enumerate(item)]
            hits = D.search(*D.as_bytes(pa.array(["", "before it " + " ".join(leak) + " after it"])), known)
            assert [(h[0], h[1]) for h in hits] == [(1, 0)], (n, changed)
        fewer = item[: n - n // 4 - 1]
        assert not D.search(*D.as_bytes(pa.array([" ".join(fewer)])), known) or n >= 18


def test_share_in_tables(spark):
    item = " ".join(f"q{k}" for k in range(15))
    d = spark.createDataFrame([(1, f"a {item.replace('q2 ', 'z ')} b"), (2, "yes we can do"), (3, "yes we can")], "doc_id long, text string")
    t = spark.createDataFrame([(1, item), (2, "We can do")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_agree, r.n_words) for r in D.contaminated(d, t, share=D.SHARE).collect()}
    assert got == {(1, 1, 14, 15), (2, 2, 3, 3)}
    assert {r.doc_id for r in D.drop_contaminated(d, t, D.SHARE).collect()} == {3}


def test_two_passages_on_one_diagonal(spark):
    """Words 0-19 and 40-59 of an item stand in a document at the same distance."""
    item = [f"i{k}" for k in range(60)]
    text = " ".join(["start", *item[:20], *(f"o{k}" for k in range(20)), *item[40:], "end"])
    d = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    t = spark.createDataFrame([(None, " ".join(item)), (5, "unrelated words")], "item_id long, text string")
    rows = sorted(((r.doc_id or 0, r.item_id, r.start, r.end, r.n_agree) for r in D.contaminated(d, t).collect()), key=lambda x: (x[0], x[2]))
    first, second = text.index("i0 "), text.index("i40")
    assert rows == [(i, None, a, b, 20) for i in (0, 1) for a, b in ((first, text.index(" o0")), (second, text.index(" end")))]


def test_very_long_texts(spark):
    item = " ".join(f"q{k}" for k in range(30))
    text = "filler word " * 200_000 + item + " more text" * 100_000
    d = spark.createDataFrame([(1, text), (2, "filler word " * 300_000)], "doc_id long, text string")
    rows = D.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"), share=D.SHARE).collect()
    assert [(r.doc_id, text.encode()[r.start : r.end].decode()) for r in rows] == [(1, item)]


def test_rows_go_by_their_own_text(spark):
    """Ids that are null or repeat don't matter; columns stay as they are."""
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(1, item, "a"), (1, "clean", "b"), (None, item, "c"), (None, "clean too", "d"), (None, None, "e"), (2, "", "f"), (2, "", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(2)
    kept = D.drop_contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string"), D.SHARE)
    assert kept.columns == d.columns and sorted(r.item_id for r in kept.collect()) == ["b", "d", "e", "f", "f"]
