"""Text functions: folding, banned words, templates, segments, receipts, derived ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: letters that look alike (Cyrillic, then Greek), and what they fold to
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "к": "k", "м": "m", "α": "a", "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "υ": "y", "τ": "t", "χ": "x"}
#: Unicode's white space, and what else separates letters.
SEPARATORS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-_.]"
# fixed values: the GSM 7-bit default alphabet and its extension
GSM_BASIC = "@£$¥èéùìòÇ\nØø\rÅåΔ_ΦΓΛΩΠΨΣΘΞÆæßÉ !\"#¤%&'()*+,-./0123456789:;<=>?¡ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÑÜ§¿abcdefghijklmnopqrstuvwxyzäöñüà"
GSM_EXTENDED = "^{}\\[~]|€"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: What composition can change: some letters below U+0300, and any text that has others.
_UNSTABLE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x300) if unicodedata.normalize("NFKC", chr(c)) != chr(c)) + r"]|[^\x{0}-\x{2ff}]"


def normalized(text: Column) -> Column:
    """Lower case, look-alikes folded, composed. Only texts that composition can change leave the JVM."""
    folded = F.translate(F.lower(text), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))
    return F.coalesce(nfkc(F.when(folded.rlike(_UNSTABLE), folded)), folded)


def despaced(text: Column) -> Column:
    """Without white space, dashes, underscores and dots."""
    return F.regexp_replace(text, SEPARATORS, "")


def folded(text: Column) -> Column:
    return despaced(normalized(text))


def normalized_word(word: str) -> str:
    """As texts are, on the driver: for words of a list."""
    return unicodedata.normalize("NFKC", word.lower().translate(str.maketrans(HOMOGLYPHS)))


def listed_words(words: list[str]) -> list[str]:
    return sorted({normalized_word(w) for w in words} - {""})


def banwords_in(plain: Column, squeezed: Column, words: list[str]) -> Column:
    """Words of a short list that occur in a normalised text or in the same without its separators, in order."""
    return F.array_compact(F.array(*(F.when(F.contains(plain, F.lit(w)) | F.contains(squeezed, F.lit(w)), w) for w in listed_words(words))))


#: Characters that are searched at once.
_AT_ONCE = 1 << 22


def banword_hits(words: list[str]) -> Callable[[Column], Column]:
    """The same of a text as it is, for a list of any length: an automaton over whole batches, built once per worker."""
    known = tuple(listed_words(words))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def hits(plain: pd.Series, squeezed: pd.Series) -> pd.Series:
        found: list[set[str]] = [set() for _ in range(len(plain))]
        for texts in (plain.fillna("").tolist(), squeezed.fillna("").tolist()):
            for i, j in _runs([len(t) for t in texts]):
                ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
                for end, word in _automaton(known).iter("\0".join(texts[i:j])):
                    found[i + int(np.searchsorted(ends, end, side="right"))].add(word)
        return pd.Series([sorted(f) for f in found])

    return lambda text: hits(normalized(text), folded(text))


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, held = i + 1, sizes[i]
        while j < len(sizes) and held + sizes[j] <= _AT_ONCE:
            held += sizes[j]
            j += 1
        yield i, j
        i = j


class _Scan:
    """Where the automaton isn't installed: one search for each word."""

    def __init__(self, words: tuple[str, ...]):
        self.words = words

    def iter(self, text: str) -> Iterator[tuple[int, str]]:
        for w in self.words:
            at = text.find(w)
            while at >= 0:
                yield at + len(w) - 1, w
                at = text.find(w, at + 1)


@cache
def _automaton(words: tuple[str, ...]):
    try:
        import ahocorasick
    except ImportError:
        return _Scan(words)
    if not words:
        return _Scan(())
    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    machine.make_automaton()
    return machine


# templates

#: A word, a number of digits within bounds, a named rule. What isn't well formed is text.
PLACEHOLDER = r"%w|%d\{(\+?[0-9]+),(\+?[0-9]+)\}|%\{([a-z][a-z0-9_]*)\}"


def placeholders(pattern: Column) -> Column:
    """The placeholders of a template, in order, as they are written."""
    return F.regexp_extract_all(pattern, F.lit(PLACEHOLDER), F.lit(0))


def literals(pattern: Column) -> Column:
    """The texts before, between and after the placeholders: one more than those, some of them empty."""
    return F.split(pattern, PLACEHOLDER, -1)


def weak_template(pattern: Column) -> Column:
    """Whether a template has no text, or a text of fewer than three characters: it would be tried on nearly all messages."""
    texts = F.filter(literals(pattern), lambda t: t != "")
    return (F.size(texts) == 0) | F.exists(texts, lambda t: F.char_length(t) < 3)


def specificity(pattern: Column) -> Column:
    """Points of the placeholders (3 for a named rule, 2 for digits, 1 for a word), then the bytes of text."""
    points = F.aggregate(placeholders(pattern), F.lit(0), lambda total, p: total + F.when(p == "%w", 1).when(F.startswith(p, F.lit("%d")), 2).otherwise(3))
    return F.struct(points.alias("points"), F.octet_length(F.array_join(literals(pattern), "")).alias("bytes"))


def parse_template(pattern: str) -> list[tuple]:
    """Parts of a template: ('text', s), ('word',), ('digits', low, high), ('name', n)."""
    parts, at = [], 0
    for m in re.finditer(PLACEHOLDER, pattern):
        if m.start() > at:
            parts.append(("text", pattern[at : m.start()]))
        parts.append(("digits", int(m[1]), int(m[2])) if m[1] else ("name", m[3]) if m[3] else ("word",))
        at = m.end()
    return parts + [("text", pattern[at:])] if at < len(pattern) else parts


@cache
def _rule(rule: str) -> re.Pattern | None:
    try:
        return re.compile(rule)
    except re.error:
        return None  # lets nothing through


def region_fits(part: tuple, region: str, names: dict[str, str]) -> bool:
    if part[0] == "word":
        return region != "" and not any(c.isspace() for c in region)
    if part[0] == "digits":
        digits = sum(c in "0123456789" for c in region)
        return all(c in "0123456789-_." or c.isspace() for c in region) and part[1] <= digits <= part[2]
    rule = _rule(names[part[1]]) if part[1] in names else None
    return rule is not None and rule.fullmatch(region) is not None


def template_matches(parts: list[tuple], text: str, names: dict[str, str]) -> bool:
    """Each text is placed at its earliest place after the one before, without going back; then the placeholder in front of it, and one at
    the end, must fit what lies between. Of placeholders that touch only the last counts. Text before a leading and after a trailing text is
    free; a template without text matches nothing.
    """
    if all(part[0] != "text" for part in parts):
        return False
    at, waiting = 0, None
    for part in parts:
        if part[0] != "text":
            waiting = part
            continue
        found = text.find(part[1], at)
        if found < 0 or waiting and not region_fits(waiting, text[at:found], names):
            return False
        waiting, at = None, found + len(part[1])
    return not waiting or region_fits(waiting, text[at:], names)


class _Templates:
    """Templates by their longest text, so that only those are tried whose text occurs."""

    def __init__(self, templates: tuple[tuple[str, str, str | None], ...]):
        self.rows = []
        by_text: dict[str, list[int]] = {}
        points = {"name": 3, "digits": 2, "word": 1, "text": 0}
        for k, (i, pattern, sender) in enumerate(templates):
            parts = parse_template(pattern)
            texts = [p[1] for p in parts if p[0] == "text"]
            self.rows.append(((-sum(points[p[0]] for p in parts), -sum(len(t.encode()) for t in texts), k), i, parts, sender))
            if texts:
                by_text.setdefault(max(texts, key=len), []).append(k)
        self.by_text, self.machine = by_text, _automaton(tuple(sorted(by_text)))

    def best(self, text: str, sender: str | None, names: dict[str, str]) -> str | None:
        tried = {k for word in {w for _, w in self.machine.iter(text)} for k in self.by_text[word]}
        for _, i, parts, bound in sorted(self.rows[k] for k in tried):
            if bound in (None, sender) and template_matches(parts, text, names):
                return i
        return None


@cache
def _compiled(templates: tuple[tuple[str, str, str | None], ...]) -> _Templates:
    return _Templates(templates)


def best_template(templates: list[tuple[str, str, str | None]], names: dict[str, str] | None = None) -> Callable[[Column, Column], Column]:
    """The id of the most specific template (id, pattern, sender) that matches; those bound to another sender don't count, ties go to the first."""
    rows, rules = tuple(templates), names or {}

    @F.pandas_udf(T.StringType())
    def best(text: pd.Series, sender: pd.Series) -> pd.Series:
        ready = _compiled(rows)
        return pd.Series([ready.best(x or "", who, rules) for x, who in zip(text, sender, strict=True)], dtype=object)

    return best


# segments


def _quoted(chars: str) -> str:
    return "".join("\\" + c if c in "\\^[]-{}&~|" else c for c in chars)


def segments(text: Column) -> Column:
    """Segments of a message: 160 septets or 153 each if all of it is in the GSM alphabet, else 70 UTF-16 units or 67 each."""
    gsm = text.rlike(f"^[{_quoted(GSM_BASIC + GSM_EXTENDED)}]*$")
    septets = F.char_length(text) + F.char_length(F.regexp_replace(text, f"[^{_quoted(GSM_EXTENDED)}]", ""))
    units = F.char_length(text) + F.char_length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))
    parts = lambda n, one, many: F.when(n <= one, 1).otherwise(F.ceil(n / many))
    return F.when(gsm, parts(septets, 160, 153)).otherwise(parts(units, 70, 67)).cast("int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_segments(text: pd.Series) -> pd.Series:
    """The segments as they are sent: filled greedily, no two-septet character across a border; UCS-2 is cut by units, even inside a pair."""

    def split(x: str | None) -> list[str]:
        x = x or ""
        if all(c in _GSM_SET for c in x):
            if sum(1 + (c in GSM_EXTENDED) for c in x) <= 160:
                return [x]
            out, room, start = [], 153, 0
            for i, c in enumerate(x):
                size = 1 + (c in GSM_EXTENDED)
                if size > room:
                    out.append(x[start:i])
                    start, room = i, 153
                room -= size
            return [*out, x[start:]]
        raw = x.encode("utf-16-le", "surrogatepass")
        if len(raw) <= 140:
            return [x]
        return [raw[i : i + 134].decode("utf-16-le", "replace") for i in range(0, len(raw), 134)]

    return text.map(split)


_GSM_SET = frozenset(GSM_BASIC + GSM_EXTENDED)


#: Stands before a two-septet character, as on the air; no text of the alphabet holds it.
_ESCAPE = "\x1b"


def sent_segments(text: Column) -> Column:
    """`split_segments` in the JVM, text by text: batches of long texts fill a Python worker."""
    text = F.coalesce(text, F.lit(""))
    every = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(0))
    parts = lambda n, one, many: F.when(n <= one, F.array(text)).otherwise(many)
    septets = F.regexp_replace(text, f"([{_quoted(GSM_EXTENDED)}])", f"{_ESCAPE}$1")
    packed = F.transform(every(septets, f"(?s).{{0,152}}[^{_ESCAPE}]"), lambda x: F.replace(x, F.lit(_ESCAPE), F.lit("")))
    # halves of a pair are decoded as U+FFFD; four digits are a unit
    digits = F.hex(F.encode(text, "UTF-16BE"))
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, "^D[C-F]..", "FFFD"), "D[89AB]..$", "FFFD")
    halves = F.transform(every(digits, ".{1,268}"), lambda x: F.decode(F.unhex(whole(x)), "UTF-16BE"))
    length = F.char_length(text)
    gsm = F.when(text.rlike(f"[{_quoted(GSM_EXTENDED)}]"), parts(F.char_length(septets), 160, packed)).otherwise(parts(length, 160, every(text, "(?s).{1,153}")))
    ucs = F.when(text.rlike(r"[^\x{0}-\x{FFFF}]"), parts(F.char_length(digits), 280, halves)).otherwise(parts(length, 70, every(text, "(?s).{1,67}")))
    return F.when(text.rlike(f"[^{_quoted(GSM_BASIC + GSM_EXTENDED)}]"), ucs).otherwise(gsm)


def receipt_field(body: Column, name: str) -> Column:
    """The value after `name:` at the start of the text or after white space, up to white space; '' if there is none."""
    return F.regexp_extract(body, rf"(?i)(?:^|\s){name}:(\S*)", 1)


def uuid3_of(name: Column) -> Column:
    """A version 3 UUID of the bytes of a name, without a namespace."""
    h = F.md5(name)
    at = lambda i, n: F.substring(h, i, n)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(at(17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("3"), at(14, 3)), F.concat(variant, at(18, 3)), at(21, 12))
