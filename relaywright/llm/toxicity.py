"""Toxicity scores by a gapped-subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two words is the inner product of their subsequences of three and of five symbols,
each weighted by decay**(symbols skipped): inserted or missing characters cost a factor, not the match. Marks of
punctuation inside a word are dropped and runs of single letters joined first. Landmarks span the
space the SVM works in (Nyström); as the kernel is an inner product of explicit features, the fitted
function folds back to one weight for each subsequence, and a text is scored in one pass
over its bytes: the score of a text is that of its worst word.

Training: words of labelled sentences, where only the text as a whole is labelled. A word witnesses
for its toxic text if it scores highest there; the worst words of clean texts are the other class;
witnesses and SVM are refitted in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import SPACE, U64, Powers, blocks, give_back, prefix, stretch
from relaywright.llm.samples import held_out, labelled

#: Bounds of the labelled sample that is fitted on: texts of each label, and distinct words of a text.
TOXIC, CLEAN, WORDS_EACH = 2_000, 3_000, 20_000
#: Landmarks, and words of clean texts that the SVM sees besides the worst of each.
LANDMARKS, PLAIN = 240, 1_500
#: A text with this score or more is toxic.
TOXIC_AT = 0.5
SYMBOLS, DECAY = 32, 0.6
#: Offsets of the later symbols from the first: three symbols with up to one skipped, five with up to one skipped.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 2, 3, 4), (2, 3, 4, 5), (1, 3, 4, 5), (1, 2, 4, 5), (1, 2, 3, 5))
#: Subsequences of three have a place each, those of five are hashed to FIVES places; weight of the latter.
THREES, FIVES, FIVE_WEIGHT = SYMBOLS**3, 1 << 17, 2.0
PLACES = THREES + FIVES
_DROP = 255


def _symbols() -> np.ndarray:
    """0: white space; 1-26: letters; 27-31: classes of other bytes of letters; 255: dropped."""
    out = np.full(256, _DROP, dtype=np.uint8)
    out[SPACE] = 0
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    for digit, letter in zip("013457@", "oieasta", strict=True):
        out[ord(digit)] = ord(letter) - 96
    for b in range(128, 192):
        out[b] = 27 + b % 5  # the second byte of a letter; the first, from 192 on, is dropped
    return out


_SYMBOL = _symbols()


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with one 0 before each word and one after the last, the place of the 0 before each word, and its text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    # one separator in front of each text and one at the end of the block
    sym = np.zeros(len(data) + n + 1, dtype=np.uint8)
    doc = np.empty(len(data) + n + 1, dtype=np.int32)
    doc[:-1] = np.repeat(np.arange(n), sizes + 1)
    doc[-1] = n - 1 if n else 0
    sym[np.arange(len(data)) + np.repeat(np.arange(n), sizes) + 1] = _SYMBOL[data]
    keep = sym != _DROP
    sym, doc = sym[keep], doc[keep]
    # join runs of single letters: drop the space between two words of one letter each
    zero = np.flatnonzero(sym == 0)
    one = np.zeros(len(zero) + 1, dtype=bool)
    one[1:-1] = np.diff(zero) == 2
    same = np.zeros(len(zero), dtype=bool)
    same[1:] = doc[zero[1:]] == doc[zero[:-1]]
    between = zero[one[:-1] & one[1:] & same & np.append(same[1:], False)]
    keep = np.ones(len(sym), dtype=bool)
    keep[between] = False
    keep[1:] &= ~((sym[1:] == 0) & (sym[:-1] == 0) & (doc[1:] == doc[:-1]))
    sym, doc = sym[keep], doc[keep]
    zero = np.flatnonzero(sym == 0)
    first = zero[:-1][np.diff(zero) > 1]
    return sym, first, doc[first + 1]


def subsequences(sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the symbols where it fits inside a word with its borders, the places of the subsequences there, their weight."""
    zero = np.flatnonzero(sym == 0)
    ends = np.append(zero[1:], len(sym) - 1)
    room = np.repeat(ends, np.diff(np.append(zero, len(sym)))) - np.arange(len(sym))  # steps to the next border
    wide = sym.astype(np.uint32)
    two = wide[:-1] * np.uint32(SYMBOLS) + wide[1:]
    for gaps in GAPS:
        last = gaps[-1]
        fits = np.flatnonzero(room >= last)
        if len(gaps) == 2:
            place = (wide[fits] * np.uint32(SYMBOLS) + wide[fits + gaps[0]]) * np.uint32(SYMBOLS) + wide[fits + last]
            yield fits, place, DECAY ** (last - 2)
        else:
            # the last two symbols stand together in all patterns but one
            end = two[fits + gaps[2]] if gaps[3] == gaps[2] + 1 else wide[fits + gaps[2]] * np.uint32(SYMBOLS) + wide[fits + gaps[3]]
            place = ((wide[fits] * np.uint32(SYMBOLS) + wide[fits + gaps[0]]) * np.uint32(SYMBOLS) + wide[fits + gaps[1]]) * np.uint32(SYMBOLS**2) + end
            yield fits, (place * np.uint32(2654435761) >> np.uint32(15)) + np.uint32(THREES), FIVE_WEIGHT * DECAY ** (last - 4)


def norms(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The norm of each word's subsequences; one that a word has several times counts with the sum of its weights. `first`: the border before each word, in order."""
    out = np.zeros(len(first))
    for i in range(0, len(first), 4096):
        j = min(i + 4096, len(first))
        part = sym[first[i] : first[j] + 1] if j < len(first) else sym[first[i] :]
        begins = first[i:j] - first[i]
        keys, weights = [], []
        for fits, place, weight in subsequences(part):
            keys.append((np.searchsorted(begins, fits, side="right") - 1) * PLACES + place.astype(np.int64))
            weights.append(np.full(len(fits), weight))
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        each = np.add.reduceat(weights, new) if len(new) else weights
        out[i:j] = np.bincount(keys[new] // PLACES, weights=each**2, minlength=j - i)
    return np.sqrt(np.maximum(out, 1e-9))


_WORD_POWERS = Powers(31)


def distinct(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words as symbols and the borders before them, and which of them each word is."""
    zero = np.flatnonzero(sym == 0)
    ends = zero[np.searchsorted(zero, first) + 1]
    sums = prefix(sym.astype(U64), _WORD_POWERS)
    _, one, of = np.unique(stretch(sums, first, ends, _WORD_POWERS), return_index=True, return_inverse=True)
    sizes = ends[one] - first[one]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(first[one] - begins[:-1], sizes) + np.arange(begins[-1])
    return np.append(sym[places], np.uint8(0)), begins[:-1], of


def word_scores(sym: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The fitted function at each word, without its bias."""
    if not len(first):
        return np.zeros(0)
    sym, first, of = distinct(sym, first)
    at = np.zeros(len(sym) + 1, dtype=np.float32)
    for fits, place, weight in subsequences(sym):
        at[fits] += weights[place] * np.float32(weight)
    return (np.add.reduceat(at, first) / norms(sym, first))[of]


def explicit(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence and weight of the normalised features of words given as symbols."""
    sym = np.frombuffer(b"".join(b"\0" + w for w in words) + b"\0", dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])[:-1].astype(np.int64)
    at, places, weights = [], [], []
    for fits, place, weight in subsequences(sym):
        at.append(np.searchsorted(first, fits, side="right") - 1)
        places.append(place.astype(np.int64))
        weights.append(np.full(len(fits), weight))
    at, places, weights = map(np.concatenate, (at, places, weights))
    return at, places, weights / norms(sym, first)[at]


def dense(words: list[bytes], column: np.ndarray, width: int) -> np.ndarray:
    """Explicit features of words, a row each; only those that `column` gives a place."""
    at, places, weights = explicit(words)
    places = column[places]
    some = places >= 0
    out = np.zeros(len(words) * width, dtype=np.float32)
    out += np.bincount(at[some] * width + places[some], weights=weights[some], minlength=len(out))
    return out.reshape(len(words), width)


def svm(x: np.ndarray, y: np.ndarray, counts: np.ndarray, cost: float = 50.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, rows weighted by counts and classes alike, by Nesterov's method."""
    weight = counts * np.where(y > 0, 0.5 / max(1e-9, counts[y > 0].sum()), 0.5 / max(1e-9, counts[y <= 0].sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    look, before = w.copy(), w.copy()
    lipschitz = 1 + 2 * cost * np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x1 @ look))
        g = look.copy()
        g[-1] = 0
        g -= 2 * cost * x1.T @ (weight * slack * y)
        w = look - g / lipschitz
        look = w + (t - 1) / (t + 2) * (w - before)
        before = w
    return w[:-1], float(w[-1])


#: The worst words of a text that its score is made of, and the most that one can count.
WORST, MOST = 3, 1.5


def worst_words(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the margins of its worst words, falling, and the log of its words. Words come in the order of their texts."""
    out = np.zeros((n, WORST + 1))
    out[:, :WORST] = -MOST
    order = np.lexsort((-score, text))
    text, score = text[order], score[order].clip(-MOST, MOST)
    begins = np.searchsorted(text, np.arange(n))
    rank = np.arange(len(text)) - begins[text]
    top = rank < WORST
    out[text[top], rank[top]] = score[top]
    out[:, WORST] = np.log1p(np.bincount(text, minlength=n))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    texts: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text of a block; a text without words counts as one of none but harmless words."""
        sym, first, doc = symbols(data, offsets)
        x = worst_words(word_scores(sym, first, self.weights) + self.bias, doc, len(offsets) - 1)
        return 1 / (1 + np.exp(-(x @ self.texts[:-1] + self.texts[-1]).clip(-60, 60)))


def _words(data: np.ndarray, most: int = WORDS_EACH) -> list[bytes]:
    """The distinct words of a text, as symbols, in order; of more than `most`, those with the smallest digests."""
    sym, _, _ = symbols(data, np.array([0, len(data)]))
    found = {w for w in sym.tobytes().split(b"\0") if len(w) > 2}
    return sorted(found if len(found) <= most else sorted(found, key=lambda w: blake2b(w, digest_size=8).digest())[:most])


def _words_of(texts: list[str]) -> list[list[bytes]]:
    return [_words(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)) for text in texts]


def _word_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct words of its text, taken in the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                words = [_words(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words, pa.list_(pa.binary()))], names=["doc_id", "words"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, words array<binary>")


def fit_words(toxic: list[list[bytes]], clean: list[list[bytes]], landmarks: int = LANDMARKS, rounds: int = 3) -> ToxicityModel | None:
    """From the distinct words of each toxic and each clean text."""
    toxic, clean = [t for t in toxic if t], [t for t in clean if t]
    if not toxic or not clean:
        return None
    groups = [*toxic, *clean]
    y = np.array([1] * len(toxic) + [-1] * len(clean))
    vocabulary = sorted({w for g in groups for w in g})
    index = {w: i for i, w in enumerate(vocabulary)}
    member = np.array([index[w] for g in groups for w in g])
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    starts = np.concatenate([[0], np.cumsum([len(g) for g in groups])])[:-1]

    sym = np.frombuffer(b"".join(b"\0" + w for w in vocabulary) + b"\0", dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in vocabulary])])[:-1].astype(np.int64)

    # the first guess: subsequences that toxic texts have too often for chance
    in_texts = np.array([np.bincount(member[y[group] == sign], minlength=len(vocabulary)) for sign in (1, -1)], dtype=float)
    seen = np.zeros((2, PLACES))
    for fits, place, _ in subsequences(sym):
        at = np.searchsorted(first, fits, side="right") - 1
        for side in (0, 1):
            seen[side] += np.bincount(place, weights=in_texts[side][at], minlength=PLACES)
    mass = in_texts.sum(axis=1)  # words, so that longer texts on one side don't matter
    pooled = seen.sum(axis=0) / mass.sum()
    z = (seen[0] / mass[0] - seen[1] / mass[1]) / np.sqrt(pooled * (1 / mass[0] + 1 / mass[1]) + 1e-12)
    weights = np.maximum(0, z - 3).astype(np.float32)
    score = word_scores(sym, first, weights)

    b = 0.0
    for _ in range(rounds):
        best = np.maximum.reduceat(score[member], starts)
        top = score[member] >= best[group]
        witness = np.unique(member[top & (y[group] > 0)])
        hard = np.unique(member[top & (y[group] < 0)])
        plain = np.unique(member[y[group] < 0])
        plain = plain[np.argsort((plain * 2654435761) % 2**32)[:PLAIN]]
        low = np.unique(np.concatenate([hard, plain]))
        witness = np.setdiff1d(witness, np.flatnonzero(in_texts[1] * len(toxic) > in_texts[0] * len(clean) * 0.2), assume_unique=True)
        if not len(witness):
            break
        by_texts = witness[np.argsort(-in_texts[0][witness], kind="stable")]
        spread = np.random.default_rng(5)
        chosen = np.concatenate([by_texts[: landmarks // 3], spread.permutation(by_texts[landmarks // 3 :])[: landmarks // 3], spread.permutation(low)[: landmarks // 3]])
        used = np.unique(explicit([vocabulary[i] for i in chosen])[1])
        column = np.full(PLACES, -1)
        column[used] = np.arange(len(used))
        base = dense([vocabulary[i] for i in chosen], column, len(used))
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        some = values > 1e-4 * values.max()
        whiten = vectors[:, some] / np.sqrt(values[some])
        use = [vocabulary[i] for i in np.concatenate([witness, low])]
        with_landmarks = np.concatenate([dense(use[k : k + 512], column, len(used)) @ base.T for k in range(0, len(use), 512)])
        x = with_landmarks @ whiten
        counts = np.concatenate([in_texts[0][witness], np.ones(len(low))])
        w, b = svm(x, np.where(np.arange(len(use)) < len(witness), 1.0, -1.0), counts)
        weights = np.zeros(PLACES, dtype=np.float32)
        weights[used] = (whiten @ w) @ base
        score = word_scores(sym, first, weights) + b
    if not weights.any():
        return None
    texts = _logistic(worst_words((word_scores(sym, first, weights) + b)[member], group, len(groups)), y > 0)
    return ToxicityModel(weights, b, texts)


def _logistic(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Logistic regression with Platt's targets, by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    w, ridge = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    for _ in range(50):
        s = 1 / (1 + np.exp(-(x @ w).clip(-40, 40)))
        step = np.linalg.solve((x * (s * (1 - s) + 1e-9)[:, None]).T @ x + ridge, x.T @ (s - target) + ridge @ w)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, seed: int = 11) -> ToxicityModel | None:
    """The model, fitted on bounded samples of labelled texts outside the held-out fold; None without both labels.

    The samples go by hash, of ids and then of their texts, equal ones once: the same from the same rows, however they are dealt.
    """
    groups = []
    for label, bound in ((1, toxic), (0, clean)):
        ids = labelled(labels, "toxic", label, bound, seed)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
        rows = _word_rows(found).distinct().withColumn("by", F.xxhash64("doc_id", "words", F.lit(seed)))
        held: dict[bytes, bytes] = {}  # a word is kept once
        groups.append([[held.setdefault(w, w) for w in x.as_py()] for x in rows.orderBy("by", "doc_id").limit(bound).select("words").toArrow()["words"]])
    return fit_words(*groups)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """`docs` with `score`, 0 to 1, of the whole text; a null text counts as empty. Without a model all score 0.

    `score` replaces a column of that name. Rows are neither dropped nor moved; equal texts score alike.
    """
    kept = [c for c in docs.columns if c != "score"]
    source = docs.select(*kept)
    if model is None:
        return source.withColumn("score", F.lit(0.0))
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(model.scores(data, offsets))], names=[*kept, "score"])
        give_back()

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more) of each row of `docs` (doc_id, text).

    Null and empty texts score as texts without words; a null doc_id is of the fold that the empty text falls
    in; rows with equal texts score alike; without texts of both labels all score 0; an empty table gives no rows; texts of
    any length are scored whole; other columns are not read.
    """
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
