"""Main text of web pages by differencing each page with its nearest page.

Pages of one host are ordered by url path; the nearest page is the neighbour in that order with the longer common path
prefix. The lines (text blocks) of both are aligned by their longest common subsequence, and shared lines go: what two
neighbours share is the site's frame. Two kinds of knowledge from the markup guard this: lines inside an element that a page
declares as its main content (article, main) are never deleted, because an article may be published twice, and elements
that are frame by their nature (nav, footer, forms, adverts ...) go even where no neighbour shows them.
"""

from __future__ import annotations

import hashlib
import html
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.llm.common import slices
from pliego.llm.url_rules import host_of, path_of
from pliego.session import kept

# A tag is read once from its start: possessive parts never go back, and a quote counts only as the start of a value.
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
VALUES = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
PLAIN = re.compile(r"([^>]*+)>")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z0-9]+")
WHITE = re.compile(r"[ \t\n\r\f\v ]+")

# Element names.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FRAME = {"nav", "footer", "aside", "head", "button", "select", "template", "svg", "menu", "canvas"}
WRAPPERS = {"form", "fieldset", "dialog", "object"}  # frame, unless the page's text is in them
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
# Words of a class, id or role that say frame.
FRAME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup",
    "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
    "alert", "alerts", "notices",
}
# Last words of such names that only say what kind of place it is, and first words that say it is elsewhere.
PLACES = {"list", "slot", "box", "area", "wrapper", "section", "container", "bar", "block", "panel", "thread", "unit", "form", "links", "items"}
ELSEWHERE = {"has", "no", "with", "without", "is", "hide", "show"}
COMMENT_WORDS = {"comment", "comments", "disqus"}


def _says_frame(name: str) -> bool:
    """Whether a name means frame: its head word, the last one before words of ``PLACES``, is one of ``FRAME_WORDS``."""
    words = WORDS.findall(name)
    if not words or words[0] in ELSEWHERE:
        return False
    if FRAME_WORDS.issuperset(words):
        return True
    while len(words) > 1 and words[-1] in PLACES:
        words.pop()
    return words[-1] in FRAME_WORDS


def _frame_names(name: str, attributes: str) -> set[str]:
    """Names of class, id and role that say frame."""
    if name in MAIN or name in ("body", "html") or not attributes:
        return set()
    names = {n for found in NAMED.findall(attributes) for n in "".join(found).lower().split()}
    return {n for n in names if _says_frame(n)}


class Wrappers:
    """The elements of a page that may be frame or may wrap its text; which it is shows when the whole page is read.

    One that holds half of the main content (article, main) is no frame, nor one that holds most of the text: by its
    class only where the page declares no main content, around comments only where there is no other text at all.
    """

    def __init__(self) -> None:
        self.outer: list[int] = []  # by wrapper: the one around it
        self.chain: list[int] = []  # the same, but none if main content begins between them
        self.named: list[bool] = []
        self.comments: list[bool] = []

    def add(self, outer: int, chain: int, names: set[str]) -> int:
        self.outer.append(outer)
        self.chain.append(chain)
        self.named.append(bool(names))
        self.comments.append((outer >= 0 and self.comments[outer]) or any(COMMENT_WORDS.intersection(WORDS.findall(n)) for n in names))
        return len(self.outer) - 1

    def kinds(self, found: list[tuple[str, bool, bool, int, int, int]]) -> list[tuple[str, bool | None]]:
        """Of (text, in frame, in main, wrapper, wrapper since main, wrapper of main) each block with whether it is main
        content, or none if it is in a frame."""
        text, inside = [0] * (len(self.outer) + 1), [0] * (len(self.outer) + 1)  # the last one is the page
        for line, frame, main, outer, chain, home in found:
            if frame:
                continue
            text[outer] += len(line)
            if main and chain < 0:
                inside[home] += len(line)
        for n in range(len(self.outer) - 1, -1, -1):
            text[self.outer[n]] += text[n]
            inside[self.outer[n]] += inside[n]
        good = []
        for n, (named, comments) in enumerate(zip(self.named, self.comments)):
            most = text[n] == text[-1] if comments else 2 * text[n] > text[-1] and not (named and inside[-1])
            holds = inside[n] > 0 and 2 * inside[n] >= inside[-1]
            good.append((most or holds) and (self.chain[n] < 0 or good[self.chain[n]]))
        stays = [not frame and (chain < 0 or good[chain]) for _, frame, _, _, chain, _ in found]
        any_ = any(stays)
        return [(line, main if stay or not (any_ or frame) else None) for stay, (line, frame, main, *_) in zip(stays, found)]


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, in main content) of each block that is not in a frame element, in page order."""
    return [(text, main) for text, main in lines_of(page) if main is not None]


def lines_of(page: str) -> list[tuple[str, bool | None]]:
    """(text, in main content, or none in a frame element) of each block, in page order.

    Frame are the elements of ``FRAME``, a header outside main content, and wrappers (see ``Wrappers``). Main content in
    a wrapper stays, but an article among comments is a comment. Unclosed elements end with their parent; a tag that is
    never finished is text to the end of the page, one whose last value is never closed ends at its first ``>``. The
    page is read once from start to end, so the time grows with its length, however long or broken it is.
    """
    found: list[tuple[str, bool, bool, int, int, int]] = []
    opened: Counter[str] = Counter()
    rest = VALUES
    stack: list[tuple] = []  # name, state around it
    wrappers = Wrappers()
    state = (False, False, -1, -1, -1)  # in frame, in main, wrapper, wrapper since main, wrapper of main
    held: list[str] = []

    def flush() -> None:
        if held:
            text = WHITE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                found.append((text, *state))

    def within(name: str, attributes: str) -> tuple:
        frame, main, outer, chain, home = state
        if frame or name in FRAME or (name == "header" and not main):
            return (True, *state[1:])
        if name == "main" or (name == "article" and not (outer >= 0 and wrappers.comments[outer])):
            return (False, True, outer, -1, outer)
        names = _frame_names(name, attributes)
        if names or name in WRAPPERS:
            outer = chain = wrappers.add(outer, chain, names)
        return (False, main, outer, chain, home)

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            break
        if begin > at:
            held.append(page[at:begin])
        at = begin
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            if end < 0:
                break
            at = end + 1
            continue
        m = NAME.match(page, begin)
        if not m:
            held.append("<")
            at = begin + 1
            continue
        tail = rest.match(page, m.end())
        if not tail and rest is VALUES:
            rest = PLAIN  # no tag from here on has all its values closed
            tail = rest.match(page, m.end())
        if not tail:
            break
        at, attributes = tail.end(), tail.group(1)
        name = m.group(2).lower()
        if m.group(1):
            if name in BLOCK or name in MAIN:
                flush()
            if opened[name]:
                while stack:
                    top, before = stack.pop()
                    opened[top] -= 1
                    if before != state:
                        flush()
                    state = before
                    if top == name:
                        break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened["p"]:
                while stack:  # a block ends an open paragraph and the inline elements in it
                    top, state = stack.pop()
                    opened[top] -= 1
                    if top == "p":
                        break
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        inner = within(name, attributes)
        if inner != state:
            flush()
        stack.append((name, state))
        opened[name] += 1
        state = inner
    held.append(page[at:])
    flush()
    return wrappers.kinds(found)


def line_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``.

    Equal ends are taken off first; for the rest, matching places are kept as chains of growing places, one per length.
    """
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(mine) - tail, len(mine))}
    places: dict[int, list[int]] = {}
    for j in range(len(other) - tail - 1, head - 1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(mine) - tail):
        for j in places.get(mine[i], ()):  # from the last place down, so a line is used once
            n = bisect_left(ends, j)
            link = (i, links[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[n], links[n] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def unshared(kinds: list[bool | None], keys: list[int], other: list[int] | None) -> tuple[list[int], int]:
    """Places of the lines that stay, and how many the neighbour takes away. All lines of both pages are aligned, those of
    frame elements too. Shared ones go, except those of the page's declared main content; of the rest, lines of frame
    elements go by the markup."""
    gone = shared_lines(keys, other) if other is not None else set()
    gone = {n for n in gone if not kinds[n]}
    return [n for n, main in enumerate(kinds) if main is not None and n not in gone], len(gone)


def main_text(page: list[tuple[str, bool | None]], keys: list[int], other: list[int] | None) -> str:
    """The lines of a page that stay beside its neighbour's."""
    left, _ = unshared([main for _, main in page], keys, other)
    return "\n\n".join(page[n][0] for n in left)


def _common_prefix(a: Column, b: Column) -> Column:
    """Path segments that both have at their start."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) == F.element_at(y, i))
    return F.coalesce(F.array_position(same, False) - 1, F.lit(0)) + F.when(F.array_position(same, False) == 0, n + 1).otherwise(0)


def nearest(pages: DataFrame) -> DataFrame:
    """(row, other): for each row (row, host, path) the nearest of its two neighbours by path on the same host.

    The order is cut into ranges of rows, so a host with a third of all pages is many tasks; the ends of the ranges, one
    row per range, are set beside each other in a second step. Pages without host and pages alone on theirs have none.
    """
    order = ["host", "path", "row"]
    ranged = pages.filter("host <> ''").select("row", "host", "path").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = kept(ranged, "ordered-pages")
    here = F.struct("host", "path", "row")
    inside = W.partitionBy("range").orderBy(*order)
    rows = ranged.withColumns({"before": F.lag(here).over(inside), "after": F.lead(here).over(inside)})
    ends = ranged.groupBy("range").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    # one row per range of thousands of pages
    beside = W.orderBy("range")
    ends = ends.select("range", F.lag("last").over(beside).alias("left"), F.lead("first").over(beside).alias("right"))
    rows = rows.join(F.broadcast(ends), "range")
    before, after = F.coalesce("before", "left"), F.coalesce("after", "right")
    score = lambda x: F.when(x["host"] == F.col("host"), _common_prefix(F.col("path"), x["path"])).otherwise(-1)
    rows = rows.withColumns({"b": before, "a": after}).withColumns({"sb": F.coalesce(score(F.col("b")), F.lit(-1)), "sa": F.coalesce(score(F.col("a")), F.lit(-1))})
    other = F.when((F.col("sb") >= F.col("sa")) & (F.col("sb") >= 0), F.col("b.row")).when(F.col("sa") >= 0, F.col("a.row"))
    return rows.select("row", other.alias("other")).filter("other is not null")


LINES = "row bigint, url string, keys array<bigint>, body bigint"
PARSED = "row bigint, page_id bigint, url string, mains array<boolean>, keys binary, packed binary"


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars, n_shared (lines that went because the neighbour has them).

    Null, empty and blank pages have an empty text. Null urls and urls without host have no neighbour. Repeated rows,
    and pages of a host with the same lines, are one page in the host's order, and returned each: a copy shows no frame.
    Of two neighbours equally near the earlier one counts. A very long page is parsed whole, by one task. Other columns are ignored; an empty table gives no rows. Pages are parsed twice, first for the digests of their lines, then
    for the lines themselves, which are compressed where they meet the neighbour's digests.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            pages_ = [lines_of(page or "") for page in batch.column("html").to_pylist()]
            keys = [[line_key(t) for t, _ in found] for found in pages_]
            body = [line_key("\n".join(t for t, main in found if main is not None)) for found in pages_]
            columns = [batch.column("row"), batch.column("url"), pa.array(keys, pa.list_(pa.int64())), pa.array(body, pa.int64())]
            yield pa.record_batch(columns, names=["row", "url", "keys", "body"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "html"):
            pages_ = [lines_of(page or "") for page in batch.column("html").to_pylist()]
            # of frame lines only the digest is needed; white space within a block is one space, so a line end can part blocks
            packed = [squeeze("\n".join(t for t, main in f if main is not None).encode("utf-8", "surrogatepass")) for f in pages_]
            keys = [array("q", [line_key(t) for t, main in f if main is None]).tobytes() for f in pages_]
            mains = pa.array([[main for _, main in f] for f in pages_], pa.list_(pa.bool_()))
            yield pa.record_batch(
                [batch.column("row"), batch.column("page_id"), batch.column("url"), mains, pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                names=["row", "page_id", "url", "mains", "keys", "packed"],
            )

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, shared = [], []
            for packed, frame, mains, other in zip(*(batch.column(c).to_pylist() for c in ("packed", "keys", "mains", "other_keys"))):
                plain = iter(unpack(packed).decode("utf-8", "surrogatepass").split("\n"))
                found = [None if main is None else next(plain) for main in mains]
                digests = iter(array("q", frame))
                keys = [next(digests) if text is None else line_key(text) for text in found]
                left, gone = unshared(mains, keys, other)
                texts.append("\n\n".join(found[n] for n in left).encode("utf-8", "replace").decode())  # lone surrogates cannot be stored
                shared.append(gone)
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(shared, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_shared"],
            )

    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    given = given.withColumn("row", F.xxhash64("page_id", "url", "html"))
    keyed = kept(given.select("row", "url", "html").mapInArrow(lines, LINES).dropDuplicates(["row"]), "page-lines")
    copy = ["host", "lines"]
    order = keyed.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("body").alias("lines"))
    order = order.filter("host <> ''")
    # pages of a host with the same lines are one page in its order: that of the first path
    first = order.groupBy(*copy).agg(F.min(F.struct("path", "row")).alias("first")).select(*copy, "first.path", "first.row")
    first = kept(first, "first-copies")
    near = first.join(nearest(first), "row").select(*copy, "other")
    near = order.select("row", *copy).join(near, copy).select("row", "other")
    near = near.join(keyed.select(F.col("row").alias("other"), F.col("keys").alias("other_keys")), "other").select("row", "other_keys")
    both = given.mapInArrow(parse, PARSED).join(near, "row", "left")
    return both.select("page_id", "url", "mains", "keys", "packed", "other_keys").mapInArrow(
        difference, "page_id bigint, url string, text string, n_chars bigint, n_shared bigint"
    )
