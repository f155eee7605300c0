"""Main text of web pages: site templates found by counting element subtrees per host.

Each page is parsed once, in the task that reads it, by a scanner that never goes back. Every container element
gets a hash of its subtree: tag, class, id, children and text (inside an article paragraphs, headings and
lists are text, not containers). Spark counts for each host the distinct page bodies that hold a subtree;
one that recurs on `MANY` or more is template and is deleted with all that it holds. Counting bodies,
not pages, keeps articles that were published many times.

What doesn't recur is judged by itself: elements that say by tag, role or class what they are (navigation,
adverts, comments) go, and of a page that names its article or main part the rest goes. That decides on
hosts with too few pages, or with parts that change from page to page. `n_template` and `n_named` tell how
many blocks of text went for which reason.

The parsed pages are written once, and the shuffle for the counts carries hashes only. The templates are broadcast after
a count of them; where there are too many, each page gets its own by a join.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywright.llm.bytetext import give_back
from relaywright.llm.runtime import materialise

#: Distinct bodies of a host that hold a subtree that is template.
MANY = 5
#: Templates of all hosts that are broadcast; more meet the pages by a shuffle of their hashes.
BROADCAST = 1_000_000

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that are left out whole, with their ends.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style textarea title noscript template svg iframe".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head nav footer aside form button select option dialog menu object audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class names and ids that say what an element is wherever they stand between dashes, and those that do only alone or before a word for a box.
_PARTS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu nav navbar navigation newsletter pagination sidebar sponsored".split())
_ALONE = frozenset("banner consent header notice pager popup promo related share sharing social sponsor subscribe toolbar widget".split())
_BOXES = frozenset("area bar block box buttons container icons inner items links list module panel section tools wrap wrapper".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody table figcaption ul ol dl article main body html br".split())
#: An opening tag closes these, if open without another container between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | dict.fromkeys("p h1 h2 h3 h4 h5 h6 div ul ol dl table section article aside header footer nav form blockquote pre main figure hr".split(), ("p",))
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}


def _digest(parts: list[str]) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', piece, ''), ('open', tag, attributes), ('close', tag, '') and ('raw', tag, ''), in one pass.

    A quote in a tag holds until the next of its kind; once a tag turns out to have no end for that, tags of this
    page end at the first '>'. A '<' that begins nothing is text; an unclosed comment or raw element takes the rest.
    """
    at, n, quotes, last = 0, len(page), True, page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        name = _NAME.match(page, lt + 1 + (following == "/"))
        if name is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = name.end()
        while quotes:
            stop = _STOP.search(page, end)
            if stop is not None and stop[0] == ">":
                end = stop.start()
                break
            end = page.find(stop[0], stop.end()) + 1 if stop is not None else 0
            quotes = end > 0
        if not quotes:
            end = page.find(">", name.end())
        tag = name[0].lower()
        at = end + 1
        if following == "/":
            yield "close", tag, ""
        elif tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = n if close is None else close.end()
            yield "raw", tag, ""
        else:
            yield "open", tag, page[name.end() : end]


class _Element:
    __slots__ = ("tag", "names", "parts", "named", "box", "main")

    def __init__(self, tag: str, names: str, named: bool, box: int, main: bool):
        self.tag, self.names, self.named, self.box, self.main = tag, names, named, box, main
        self.parts: list[str] = []


def _says(names: str) -> bool:
    """Whether a class or id tells that an element is no part of the text."""
    for name in names.split():
        words = re.findall("[a-z]+", name)
        if not _PARTS.isdisjoint(words) or words and words[0] in _ALONE and _BOXES.issuperset(words[1:]):
            return True
    return False


class Parsed:
    """Containers (`boxes`: hash of the subtree, and the number of the one around, -1 for none), and blocks of text with the box that they
    stand in, whether a name says that they are no part of the text, and whether they stand in the main part."""

    def __init__(self, page: str):
        self.hashes: list[int] = []
        self.around: list[int] = []
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.has_main = False
        self._text: list[str] = []
        self._stack = [_Element("", "", False, -1, False)]
        self._containers: list[int] = []  # places in the stack of elements that aren't inline
        self._open: Counter[str] = Counter()
        for kind, value, attributes in tokens(page):
            if kind == "text":
                piece = html.unescape(value)
                self._text.append(piece)
                self._stack[-1].parts.append(" ".join(piece.split()))
            elif kind == "raw":
                if value in ("title", "svg", "iframe"):
                    self._flush()
            else:
                if value == "br":
                    self._text.append(" ")
                elif value not in _INLINE:
                    self._flush()
                if kind == "open":
                    self._start(value, attributes)
                elif self._open[value]:
                    k = len(self._stack) - 1
                    while self._stack[k].tag != value:
                        k -= 1
                    self._close(k)
        self._flush()
        self._close(1)

    def _flush(self) -> None:
        if self._text:
            words = " ".join("".join(self._text).split())
            self._text.clear()
            if words:
                top = self._stack[-1]
                self.blocks.append((words, top.box, top.named, top.main))

    def _close(self, to: int) -> None:
        while len(self._stack) > to:
            e = self._stack.pop()
            self._open[e.tag] -= 1
            if self._containers and self._containers[-1] == len(self._stack):
                self._containers.pop()
            digest = _digest([e.tag, e.names, *e.parts])
            above = self._stack[-1]
            above.parts.append(str(digest))
            if e.box != above.box:
                self.hashes[e.box] = digest

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _VOID:
            return
        for k in reversed(self._containers):
            open_tag = self._stack[k].tag
            if open_tag in _CLOSES.get(tag, ()):
                self._close(k)
                break
            if open_tag in _SCOPE.get(tag, ()) or open_tag not in ("td", "th"):
                break
        above = self._stack[-1]
        names, role, inline = "", "", tag in _INLINE
        if attributes and not inline:
            for a in _NAMES.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "role":
                    role = value
                else:
                    names += " " + value
        sayable = tag not in ("html", "body", "main") and not (above.main and tag in _TEXT_TAGS and tag not in ("ul", "ol", "dl", "table"))
        named = above.named or tag in _NEVER or role in _ROLES or (sayable and _says(names)) or (tag == "header" and not above.main)
        main = above.main or (not named and (tag in ("article", "main") or role == "main"))
        self.has_main |= main
        box = above.box
        if not inline and (tag not in _TEXT_TAGS or not main and tag not in ("html", "body")):
            box = len(self.hashes)
            self.hashes.append(0)
            self.around.append(above.box)
        if not inline:
            self._containers.append(len(self._stack))
        self._open[tag] += 1
        self._stack.append(_Element(tag, names, named, box, main))

    def kept_by_name(self) -> list[bool]:
        return [not named and (main or not self.has_main) for _, _, named, main in self.blocks]

    def body(self) -> int:
        """A hash of the text that names leave."""
        return _digest([block[0] for block, kept in zip(self.blocks, self.kept_by_name(), strict=True) if kept])


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_COLUMNS = {"key": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "body": pa.int64(), "hashes": pa.list_(pa.int64()), "around": pa.list_(pa.int32()), "packed": pa.binary(), "boxes": pa.list_(pa.int32()), "kept": pa.list_(pa.bool_())}
_PARSED = "key long, page_id long, url string, host string, body long, hashes array<long>, around array<int>, packed binary, boxes array<int>, kept array<boolean>"
_PAGES_AT_ONCE = 200


def parsed(pages: DataFrame) -> DataFrame:
    """A row for each page; `key` is made from page_id, url and html."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _PAGES_AT_ONCE):
                batch = whole.slice(i, _PAGES_AT_ONCE)
                rows = []
                for page_id, url, page, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p = Parsed(page or "")
                    rows.append((key, page_id, url, host(url), p.body(), p.hashes, p.around, zlib.compress("\n".join(b[0] for b in p.blocks).encode("utf-8", "surrogatepass"), 1), [b[1] for b in p.blocks], p.kept_by_name()))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], names=list(_COLUMNS))
        give_back()

    return source.mapInArrow(run, _PARSED)


def templates(pages: DataFrame, many: int = MANY) -> DataFrame:
    """host and hash of each subtree that recurs on `many` distinct bodies or more; `pages` as parsed."""
    held = pages.select("host", "body", F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
    return held.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= many).select("host", "hash")


def remains(hashes: list[int], around: list[int], boxes: list[int], dropped: set[int]) -> list[bool]:
    """Which blocks stand in no dropped subtree; boxes come after those around them."""
    gone: list[bool] = []
    for h, above in zip(hashes, around, strict=True):
        gone.append(h in dropped or above >= 0 and gone[above])
    return [box < 0 or not gone[box] for box in boxes]


class Site:
    """Templates by host, for so few that every task can hold them."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("host", "ascending"), ("hash", "ascending")])
        self.hashes = rows.column("hash").to_numpy()
        hosts = rows.column("host").to_pylist()
        self.begins: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        for k, name in enumerate(hosts):
            self.begins.setdefault(name, k)
            self.ends[name] = k + 1

    def among(self, name: str, hashes: list[int]) -> set[int]:
        of = self.hashes[self.begins.get(name, 0) : self.ends.get(name, 0)]
        if not len(of) or not hashes:
            return set()
        own = np.array(hashes)
        return set(own[of[np.minimum(np.searchsorted(of, own), len(of) - 1)] == own].tolist())


_TEXT = "page_id long, url string, text string, n_template long, n_named long"


def _written(pages: DataFrame, site=None) -> DataFrame:
    """The text of each page; `pages` as parsed, with `dropped`, or with the templates of all hosts broadcast."""
    columns = ["page_id", "url", "hashes", "around", "packed", "boxes", "kept", "host" if site else "dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, hashes, around, packed, boxes, kept, last in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                texts = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")[: len(boxes)]  # blocks have no line ends
                stays = remains(hashes, around, boxes, site.value.among(last, hashes) if site else set(last or ()))
                text = "\n".join(t for t, a, b in zip(texts, stays, kept, strict=True) if a and b)
                rows.append((page_id, url, text, stays.count(False), sum(a and not b for a, b in zip(stays, kept, strict=True))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_template", "n_named"])
        give_back()

    return pages.select(*columns).mapInArrow(run, _TEXT)


def extract(pages: DataFrame, many: int = MANY, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of `pages` (page_id, url, html); n_template and n_named, the blocks of text
    that went because their subtree recurs, and of the others because of what they or the page say.

    A null or empty page, and one that is all template, has the empty text. A page without a host
    belongs to the host ''. Repeated rows give equal rows; other columns are not read; an empty
    table gives no rows. A page of any length and depth takes time in proportion to its length, but is held as one.
    """
    scan = materialise(parsed(pages), "pages")
    site = materialise(templates(scan, many), "templates")
    if site.count() <= broadcast:
        out = _written(scan, pages.sparkSession.sparkContext.broadcast(Site(site.toArrow())))
    else:
        held = scan.select("key", "host", F.explode(F.array_distinct("hashes")).alias("hash"))
        dropped = held.join(site, ["host", "hash"], "left_semi").groupBy("key").agg(F.collect_set("hash").alias("dropped"))
        out = _written(scan.join(dropped, "key", "left"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template", "n_named")
