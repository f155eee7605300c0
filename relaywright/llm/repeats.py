"""Repeated lines and sentences: hashed units grouped over all documents, the earliest kept.

A unit is a stretch of one line that ends where a sentence of `SENTENCE_WORDS` words or more
ends, or with the line. Units are normalised (ASCII lower case, no ASCII punctuation or control
characters, single spaces) and hashed to 128 bits; those of fewer than `MIN_WORDS` words are
always kept. Of equal units the one with the smallest (doc_id, position) stays, the others are cut
out by their byte offsets in the original text. `drop_repeats` takes each whole line for a unit
as well, so that a repeated line goes with its short sentences and its tail.

One shuffle groups digests to find those that occur twice, with partial aggregation before it;
a second brings their occurrences to them, and Spark splits a hot digest's side of that join,
as the other side has one row for each digest. Then the cuts go to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import SPACE, U64, Powers, blocks, give_back, lower_ascii, mix, owner, prefix, stretch, table, words

SENTENCE_WORDS, MIN_WORDS = 4, 6

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(128) if not chr(b).isalnum() and b not in (32, 9, 10, 11, 12, 13)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_HASHES = [(table(51 + i, lower_ascii), Powers(53 + i), Powers(57 + i)) for i in (0, 1)]


def units(data: np.ndarray, offsets: np.ndarray, lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte in its block, and digest (two columns) of each unit that can be cut; with `lines` whole lines too, and of a line's units those with fewer words."""
    none = np.zeros(0, dtype=np.int64)
    starts, ends = words(data, offsets)
    if not len(starts):
        return none, none, none, np.zeros((0, 2), dtype=U64)
    text = owner(offsets, starts)
    # does a line end between a word and the next?
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (text[1:] != text[:-1])
    stop = _STOP[data[ends - 1]] | last
    # a sentence runs from the word after a stop to the next stop; a unit closes at one that is long enough
    at = np.flatnonzero(stop)
    length = np.diff(np.concatenate([[-1], at]))
    closes = at[(length >= SENTENCE_WORDS) | last[at]]
    opens = np.concatenate([[0], closes[:-1] + 1])
    solid = ~_PUNCT[data]
    kept = np.concatenate([[0], np.cumsum(solid)])
    w0, w1 = kept[starts], kept[ends]
    real = w1 > w0  # words of punctuation only don't count
    count = np.concatenate([[0], np.cumsum(real)])
    n_words = count[closes + 1] - count[opens]
    some = n_words >= MIN_WORDS
    if lines:
        to = np.flatnonzero(last)
        since = np.concatenate([[0], to[:-1] + 1])
        in_line = count[to + 1] - count[since]
        # a unit with all words of its line is the line, which would else have an equal inside itself
        some &= n_words < in_line[np.searchsorted(to, closes)]
        whole = in_line >= MIN_WORDS
        opens, closes = np.concatenate([opens[some], since[whole]]), np.concatenate([closes[some], to[whole]])
    else:
        opens, closes = opens[some], closes[some]
    digest = np.empty((len(opens), 2), dtype=U64)
    squeezed = data[solid]
    for i, (values, by_byte, by_word) in enumerate(_HASHES):
        word = stretch(prefix(values[squeezed], by_byte), w0[real], w1[real], by_byte)
        digest[:, i] = stretch(prefix(mix(word), by_word), count[opens], count[closes + 1], by_word)
    return text[opens], starts[opens], ends[closes], digest


_UNIT = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def unit_rows(docs: DataFrame, lines: bool = False) -> DataFrame:
    """A row for each unit; `docs` has row, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, _, data, offsets in blocks(batch.column(2)):
                text, start, end, digest = units(data, offsets, lines)
                base = offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[i + text]), pa.array(doc_id[i + text]), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), *(pa.array(np.ascontiguousarray(digest[:, k]).view(np.int64)) for k in (0, 1))],
                    names=_UNIT.names,
                )
        give_back()

    return docs.select("row", "doc_id", "text").mapInArrow(run, _UNIT)


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `row`: a number made from doc_id and text, alike for repeated rows, and doc_id as long (null: the smallest)."""
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("row", F.xxhash64("doc_id", "text"))


def repeated(docs: DataFrame, lines: bool = False) -> DataFrame:
    """row, doc_id, start, end of each unit that an earlier one equals; with `lines` a line's units may stand beside the line."""
    found = unit_rows(docs, lines)
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = found.join(firsts, ["h1", "h2"]).filter(F.struct("doc_id", "row", "start") > F.col("first"))
    return again.select("row", "doc_id", "start", "end")


def outermost(cuts: list[dict] | None) -> list[dict] | None:
    """Ranges in order (start, end) without those inside others."""
    if not cuts:
        return cuts
    out = []
    for c in cuts:
        if out and c["start"] == out[-1]["start"]:
            out[-1] = c
        elif not out or c["start"] >= out[-1]["end"]:
            out.append(c)
    return out


def cut_text(docs: DataFrame, cuts: str = "cuts") -> DataFrame:
    """`text` without the byte ranges in `cuts` (start and end, in order), and the line ends that they leave bare; ranges inside others leave `cuts`."""
    at, where = docs.columns.index("text"), docs.columns.index(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, outer = [], []
            texts, ranges = batch.column(at), batch.column(where)
            for text, cut in zip(texts, ranges, strict=True):
                cut = outermost(cut.as_py())
                outer.append(cut)
                if not cut:
                    out.append(text.as_py())
                    continue
                raw, kept, done = text.as_py().encode("utf-8", "surrogatepass"), [], 0
                for c in cut:
                    start, end = c["start"], c["end"]
                    # a cut that leaves a line empty takes the line's end with it; one inside a line the space after it
                    whole = start == 0 or raw[start - 1 : start] == b"\n" or (kept and done == start and not kept[-1].strip(b" \t"))
                    while raw[end : end + 1] in (b" ", b"\t", b"\r"):
                        end += 1
                    if whole and raw[end : end + 1] == b"\n":
                        end += 1
                    kept.append(raw[done:start])
                    done = end
                kept.append(raw[done:])
                out.append(b"".join(kept).decode("utf-8", "replace"))
            columns = list(batch.columns)
            columns[at] = pa.array(out, type=pa.string())
            columns[where] = pa.array(outer, type=ranges.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with text less its repeated lines and units, and n_bytes and n_removed (of the text), n_spans and cuts (byte ranges in the original text).

    Null and empty texts and texts of short units stay as they are; rows equal in doc_id and text
    count as one document, whose copies lose the same units; an empty table gives no rows.
    Columns named row, cuts, n_bytes, n_removed or n_spans are replaced.
    """
    source = keyed(docs.drop("row", "cuts", "n_bytes", "n_removed", "n_spans"))
    removed = repeated(source, lines=True)
    by_row = removed.distinct().groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    joined = source.join(by_row, ["row", "doc_id"], "left").withColumn("n_bytes", size)
    out = cut_text(joined).withColumn("n_removed", F.col("n_bytes") - size)
    out = out.withColumn("n_spans", F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long"))
    return out.drop("row").withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
