"""Repeated units against a brute-force version in plain Python."""

import re

from relaywright.llm.repeats import MIN_WORDS, SENTENCE_WORDS, drop_repeats, keyed, repeated

WS = re.compile(rb"[^\x20\x09-\x0d]+")


def plain_units(text):
    """(start, end, normal form) of each unit of a text that can be cut."""
    raw = text.encode()
    found = [(m.start(), m.end()) for m in WS.finditer(raw)]
    out, unit, sentence = [], [], 0
    for k, (s, e) in enumerate(found):
        unit.append((s, e))
        sentence += 1
        last = k + 1 == len(found) or b"\n" in raw[e : found[k + 1][0]]
        stop = raw[e - 1 : e] in (b".", b"!", b"?") or last
        if stop:
            if sentence >= SENTENCE_WORDS or last:
                words = [re.sub(rb"[^A-Za-z0-9\x80-\xff]", b"", raw[a:b]).lower() for a, b in unit]
                words = [w for w in words if w]
                if len(words) >= MIN_WORDS:
                    out.append((unit[0][0], unit[-1][1], b" ".join(words)))
                unit = []
            sentence = 0
    return out


def plain(rows):
    first, cuts = {}, set()
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for s, e, norm in plain_units(text or ""):
            if norm in first and first[norm] != (doc_id, s):
                cuts.add((doc_id, s, e))
            else:
                first.setdefault(norm, (doc_id, s))
    return cuts


CASES = [
    (1, "One two three four five six.\nA line of its own with many words here"),
    (2, "one TWO, three four five six!\nOther words that do not stand anywhere else at all."),
    (3, None),
    (4, ""),
    (5, "Short. One two three four five six. One two three four five six."),
    (6, "a line of its own with many words here"),
    (7, "été été été été été été. x. y. z. été été été été été été."),
    (8, "   \n\n... --- ... --- ... ---\n"),
    (9, "word " * 3000),
    (10, "word " * 3000),
]


def test_cuts_match_brute_force(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in repeated(keyed(docs)).collect()}
    assert got == plain(CASES)


def test_cuts_match_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.start, r.end) for r in repeated(keyed(docs)).collect()}
    assert got == plain(rows)


def test_text_and_extra_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in CASES] + [(None, "One two three four five six.", "x", 5)], "doc_id long, text string, row string, n_removed int")
    out = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert len(out) == len(CASES) + 1
    assert out[None].text == "One two three four five six."  # a null id ranks first
    assert out[1].text == "A line of its own with many words here"
    assert out[2].text == "Other words that do not stand anywhere else at all."
    assert out[3].text is None and out[4].text == ""
    assert out[6].text == "" and out[6].n_spans == 1 and out[6].n_removed == 38
    assert out[9].text == "word " * 3000 and out[10].text == ""


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame(CASES[:2], "doc_id long, text string")
    assert drop_repeats(docs.limit(0)).count() == 0
    twice = drop_repeats(docs.union(docs)).collect()
    assert len(twice) == 4 and len({(r.doc_id, r.text) for r in twice}) == 2


def test_repeated_lines_go_whole(spark):
    """Lines of short sentences and with short tails; a line stays where its sentences alone repeat."""
    short, tail = "Ab cd ef gh. Ij kl mn. Op qr.", "One two three four five six seven. The tail."
    rows = [
        (1, f"{short}\n{tail}\nThe first end of it is here now"),
        (2, f"Before it.\n{short.upper()}\n{tail}"),
        (3, f"{tail} And more words follow this one.\nToo short a line.\n{short}"),
        (4, "Too short a line.\n... One two three, four five six seven - the TAIL!"),
        (5, "--- --- --- ---. Some six new words in here.\nx"),
    ]
    out = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[5].text == rows[4][1]
    assert out[2].text == "Before it.\n" and out[2].n_spans == 2
    assert out[3].text == "The tail. And more words follow this one.\nToo short a line.\n"
    assert out[4].text == "Too short a line.\n"
    assert all(a.end <= b.start for r in out.values() for a, b in zip(r.cuts or [], (r.cuts or [])[1:]))
