"""Main text of web pages by differencing with the pages of nearest URL.

Every page becomes lines: the text of one block each (character references decoded, white space inside
it one space), with the kind of its element and its zone: inside something that is never main text
(menus, footers, adverts, forms ...), inside a declared main container, or neither.

The pages of a host stand in the order of their URL paths.  Each page is aligned with the `NEAR` pages
before and after it by a longest common subsequence of lines; lines that most of these pages share are
the host's boilerplate and go.  A pair whose remaining text is nearly all the same are copies of one page
and tell nothing.  What an article repeats of another article must stay, however: a shared line inside
a declared main container goes only if it is no heading and all lines of its kind on the page are shared,
as those of a site's notice are and those of prose are not.

Lines stay where they are: only line keys (8 bytes) are dealt by URL order, in chunks that overlap by
`NEAR` pages, and the numbers of the lines to delete come back, for pages that lose any.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.functions.ordered import row_number
from curbledger.llm import words as W
from curbledger.session import near as few_rows
from curbledger.session import stored

NEAR = 2           # pages on each side that a page is aligned with
CHUNK = 1000       # pages of one place in the URL order
COPY_SHARE = 0.1   # with less unshared text than this share, a page is a copy of its neighbour
SIDE, MAIN, OPEN = 0, 1, 2

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
SKIPPED = set("head noscript template button select option datalist svg canvas audio video object map".split())
SIDE_TAGS = set("nav footer aside form menu dialog".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | SIDE_TAGS | set(
    "html body address article blockquote caption center dd details dir div dl dt fieldset figcaption figure header hgroup hr br legend li "
    "main ol optgroup p pre section summary table tbody td tfoot th thead tr ul head".split())
#: Start tags that end an open element of the same list, if none of its bounds is in between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
          "body": ({"head"}, {"body"})}
CLOSES |= {"tbody": CLOSES["thead"], "tfoot": CLOSES["thead"]}
#: Words of class and id names of what is beside the main text; the second list holds outside of main containers only.
SIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social comment comments disqus respond related recommended pagination pager toolbar searchform".split())
OUTER_WORDS = set("header masthead topbar banner alert search legal copyright".split())
INLINE_WORDS = set("ad ads adv advert adverts advertisement sponsor sponsored".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"                                                          # comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)"  # tag
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Element:
    tag: str
    parent: int
    side: int = 0          # 1: never main text; 2: so by its class, id or role
    main: bool = False
    label: str = ""
    chars: int = 0


@dataclass
class Page:
    texts: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    zones: list[int] = field(default_factory=list)
    heads: list[bool] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Reader:
    """Lines and elements of one page; tag soup is read as far as it goes."""

    def __init__(self):
        self.page, self.elements = Page(), [Element("", -1)]
        self.open: list[tuple[str, int, bool]] = []  # tag, block element it stands in or is, skipped or not
        self.text: list[str] = []
        self.skipping = 0

    def block(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            at = self.block()
            own = self.elements[at]
            up = self.elements[own.parent] if own.parent >= 0 else own
            self.page.texts.append(line)
            self.page.kinds.append(f"{up.label}/{own.label}")
            self.page.owners.append(at)
            self.page.heads.append(self.headed(at))
            own.chars += len(line)

    def headed(self, at: int) -> bool:
        while at > 0:
            if self.elements[at].tag in HEADINGS:
                return True
            at = self.elements[at].parent
        return False

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _, skipped = self.open[-1]
            if tag in BLOCKS:
                self.flush()
            self.open.pop()
            self.skipping -= skipped

    def close(self, tags: set[str], bounds: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self.pop_to(k)
                return
            if self.open[k][0] in bounds:
                return

    def start(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag not in ("html", "body"):
                self.close({"p"}, {"table", "td", "th", "button", "object", "caption"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in VOID:
            return
        attributes = _attributes(source) if source.strip() else {}
        names = _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag not in BLOCKS:
            skipped = tag in SKIPPED or hidden or not INLINE_WORDS.isdisjoint(names)
            self.open.append((tag, self.block(), skipped))
            self.skipping += skipped
            return
        at = self.block()
        inside = at
        while inside > 0 and not self.elements[inside].main:
            inside = self.elements[inside].parent
        role = attributes.get("role", "").lower()
        own = Element(tag, at, main=tag in ("article", "main") or role in ("article", "main") or attributes.get("itemprop", "") == "articleBody",
                      label=".".join([tag, *sorted(set(names))]))
        if tag not in ("html", "body"):
            if tag in SIDE_TAGS or hidden or (tag == "header" and inside <= 0):
                own.side = 1
            elif role in SIDE_ROLES or not SIDE_WORDS.isdisjoint(names) or (inside <= 0 and not own.main and not OUTER_WORDS.isdisjoint(names)):
                own.side = 2
        self.elements.append(own)
        skipped = tag in SKIPPED
        self.open.append((tag, len(self.elements) - 1, skipped))
        self.skipping += skipped

    def end(self, tag: str) -> None:
        if tag in ("br", "hr", "p") and not any(t == tag for t, _, _ in self.open):
            self.flush()
            return
        bounds = {"table", "td", "th", "caption"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else set()
        if tag not in BLOCKS and tag not in SKIPPED:
            bounds = BLOCKS
        self.close({tag}, bounds)

    def read(self, html: str) -> Page:
        at, n = 0, len(html)
        while at < n:
            to = html.find("<", at)
            to = n if to < 0 else to
            if to > at and not self.skipping:
                self.text.append(unescape(html[at:to]))
            if to == n:
                break
            found = _TOKEN.match(html, to)
            if not found:  # a lone "<"
                if not self.skipping:
                    self.text.append("<")
                at = to + 1
                continue
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag or not found[0].endswith(">"):  # a comment, a declaration, or a tag cut off by the end
                continue
            if found[1]:
                self.end(tag)
            elif tag in RAW:
                if tag in BLOCKS:
                    self.flush()
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
            else:
                self.start(tag, found[3])
        self.pop_to(0)
        self.flush()
        self.settle()
        return self.page

    def settle(self) -> None:
        """Zones of all lines.  What holds the page's main container is not beside it, whatever it is called."""
        elements = self.elements
        for e in reversed(elements[1:]):
            elements[e.parent].chars += e.chars
        sided = [False] * len(elements)
        for k, e in enumerate(elements):
            sided[k] = bool(e.side) or (e.parent >= 0 and sided[e.parent])
        mains = [k for k, e in enumerate(elements) if e.main and not e.side and e.chars]
        mains = [k for k in mains if not sided[k]] or mains
        keep: set[int] = set()
        if mains:
            k = max(mains, key=lambda k: (elements[k].tag != "main", elements[k].chars))
            while k >= 0:
                keep.add(k)
                k = elements[k].parent
        else:  # a form or a class name around more than half of all text does not make it a side matter
            keep = {k for k, e in enumerate(elements) if 2 * e.chars > elements[0].chars and (e.side == 2 or e.tag == "form")}
        side, main = [False] * len(elements), [False] * len(elements)
        for k, e in enumerate(elements):
            up = e.parent
            side[k] = (up >= 0 and side[up]) or (bool(e.side) and k not in keep)
            main[k] = ((up >= 0 and main[up]) or (e.main and bool(mains))) and not side[k]
        zones = [SIDE if side[k] else MAIN if main[k] else OPEN for k in self.page.owners]
        if MAIN in zones:
            zones = [SIDE if z == OPEN else z for z in zones]
        self.page.zones = zones


def read_page(html: str | None) -> Page:
    """The lines of a page; a NULL page has none."""
    return _Reader().read(html or "")


def shared(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two lists, none of which has an item twice."""
    place = {x: j for j, x in enumerate(right)}
    tails: list[int] = []       # last place of the best chain of each length
    ends: list[int] = []        # its number among `links`
    links: list[tuple[int, int, int]] = []
    for i, x in enumerate(left):
        j = place.get(x)
        if j is None:
            continue
        k = bisect_left(tails, j)
        links.append((i, j, ends[k - 1] if k else -1))
        if k == len(tails):
            tails.append(j)
            ends.append(len(links) - 1)
        else:
            tails[k], ends[k] = j, len(links) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = links[at]
        out.append((i, j))
    return out[::-1]


class _Lines:
    """Keys of a page's lines while its neighbours go by.  A line that recurs on its page is aligned once."""

    def __init__(self, row: dict):
        self.row, self.own, self.host = row["row"], row["own"], row["host"]
        self.zones, self.heads = np.frombuffer(row["zones"], np.int8), np.frombuffer(row["heads"], np.int8).astype(bool)
        self.kinds, self.sizes = np.frombuffer(row["kinds"], "<i4"), np.frombuffer(row["sizes"], "<i4")
        keys = np.frombuffer(row["keys"], "<u8")
        self.keys, self.first, self.unique = np.unique(keys, return_index=True, return_inverse=True)
        self.in_order = np.argsort(self.first)
        self.list = self.keys[self.in_order].tolist()
        weight = np.where(self.zones != SIDE, self.sizes, 0)
        self.weights = np.bincount(self.unique, weight, len(self.keys))[self.in_order] if len(keys) else np.zeros(0)
        self.votes, self.seen = np.zeros(len(self.list), np.int64), 0

    def meet(self, other: _Lines) -> None:
        pairs = np.array(shared(self.list, other.list), np.int64).reshape(-1, 2)
        for page, mine in ((self, pairs[:, 0]), (other, pairs[:, 1])):
            if page.weights.sum() - page.weights[mine].sum() < COPY_SHARE * page.weights.sum() or not page.weights.sum():
                return  # copies, or no text at all
        for page, mine in ((self, pairs[:, 0]), (other, pairs[:, 1])):
            page.votes[mine] += 1
            page.seen += 1

    def deleted(self) -> list[int]:
        """Numbers of the lines outside side matter that go."""
        if not self.seen:
            return []
        of_key = np.empty(len(self.list), bool)
        of_key[self.in_order] = 2 * self.votes > self.seen
        common = of_key[self.unique]
        gone = common & (self.zones == OPEN)
        main = (self.zones == MAIN) & ~self.heads
        if main.any() and not common[main].all():
            prose = np.unique(self.kinds[main & ~common])
            gone |= main & common & ~np.isin(self.kinds, prose)
        return np.flatnonzero(gone).tolist()


def deletions(pages: list[dict], near: int = NEAR) -> list[tuple[int, list[int]]]:
    """(row, numbers of deleted lines) of the chunk's own pages, given in URL order; pages without any are left out."""
    out, window = [], deque()
    for row in pages:
        page = _Lines(row)
        for other in window:
            if other.host == page.host:
                other.meet(page)
        window.append(page)
        if len(window) > near:
            out.append(window.popleft())
    return [(p.row, d) for p in [*out, *window] if p.own and (d := p.deleted())]


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("texts", pa.list_(pa.string())), ("at", pa.list_(pa.int32())),
    ("keys", pa.binary()), ("zones", pa.binary()), ("heads", pa.binary()), ("kinds", pa.binary()), ("sizes", pa.binary()),
])
_READ_DDL = ("page_id long, url string, host string, path string, texts array<string>, at array<int>, keys binary, zones binary, heads binary, "
             "kinds binary, sizes binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "html"):
        rows = []
        for number, url, host, path, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "html"))):
            page = read_page(html)
            zones = np.array(page.zones, np.int8)
            at = np.flatnonzero(zones != SIDE)
            names = {k: i for i, k in enumerate(dict.fromkeys(page.kinds))}
            keys = b"".join(hashlib.blake2b(f"{k}\n{t}".encode("utf-8", "surrogatepass"), digest_size=8).digest() for k, t in zip(page.kinds, page.texts))
            rows.append((number, url, host, path, [page.texts[i].encode("utf-8", "replace").decode() for i in at], at.tolist(), keys, zones.tobytes(), np.array(page.heads, np.int8).tobytes(),
                         np.array([names[k] for k in page.kinds], "<i4").tobytes(), np.array([len(t) for t in page.texts], "<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def _compare(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, pages = None, []

        def done() -> pa.RecordBatch:
            found = deletions(pages, near)
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([d for _, d in found], pa.list_(pa.int32()))], ["row", "drop"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != chunk:
                    if pages:
                        yield done()
                    chunk, pages = row["chunk"], []
                pages.append(row)
        if pages:
            yield done()

    return run


def main_texts(pages: DataFrame, near: int = NEAR, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, lines (array, in page order): one row per row of `pages`, repeated rows too.

    A NULL html is an empty page, without lines.  A NULL url, or one without a host, is a page of the host
    ''.  Other columns are not read.  `chunk` is at least twice `near`.
    """
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?[^/?#]*", "")
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "").alias("host"),
        F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), r"(?:/index)?(?:\.html?|\.php)?/*$", "").alias("path"))
    read = stored(named.mapInArrow(_read, _READ_DDL).withColumn("row", F.monotonically_increasing_id()))
    light = read.select("row", "host", "path", "keys", "zones", "heads", "kinds", "sizes")
    ranked = row_number(light, [], ["host", "path", "row"], "rank")
    here = ((F.col("rank") - 1) / chunk).cast("long")
    within = (F.col("rank") - 1) % chunk
    places = F.array_compact(F.array(here, F.when(within < near, here - 1), F.when(within >= chunk - near, here + 1)))
    dealt = ranked.withColumn("_here", here).withColumn("chunk", F.explode(places)).withColumn("own", F.col("chunk") == F.col("_here")).drop("_here")
    drops = stored(dealt.repartition("chunk").sortWithinPartitions("chunk", "rank").mapInArrow(_compare(near), "row long, drop array<int>"))
    numbers = drops.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    lines = F.transform(F.filter(F.arrays_zip("texts", "at"), lambda x: ~F.array_contains("drop", x["at"])), lambda x: x["texts"])
    return read.select("page_id", "url", "texts", "at", "row").join(few_rows(drops, numbers), "row", "left").select(
        "page_id", "url", F.when(F.col("drop").isNull(), F.col("texts")).otherwise(lines).alias("lines"))


def op12_page_text(pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", F.array_join("lines", "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
