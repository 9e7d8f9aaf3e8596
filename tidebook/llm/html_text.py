"""HTML extraction by wrapper induction: what the pages of a host share is its template, what varies in it is content.

A page becomes a tree of its block elements. Text blocks of one kind below an element are one node, so a list of any length is one slot; containers of one
kind (tag and class) stay apart up to the eighth. Trees of same-host pages are aligned by simple tree matching (Yang, 1991) and merged into the
host's wrapper: each node knows how many pages have it, in how many of them a text is in it, and how much of its text is in links. Rare nodes and texts are forgotten within
a stated error, so a wrapper is bounded by the template. Merging wrappers is merging pages, so every task folds the pages it has, and the partial
wrappers of a host are merged in rounds of FAN; no task needs a host's pages together.

The wrapper then tells the region of a host's content: from the root it leads down to the container that has most of the text that varies from page to
page, and takes in what else has much of it. A page is aligned with its host's wrapper; its blocks in that region are its text, without those constant in their slot.
Names of classes and ids only help where the wrapper can't tell: adverts and reader comments vary like content. Pages of a host too small for a
wrapper are told by main elements and links alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, slices

#: Pages of a host from which its wrapper tells the content.
MIN_PAGES = 3
#: Share of a slot's pages from which a text is template, and the share that a count may be too small by, as rare texts and nodes are forgotten.
MOST_PAGES, FORGOTTEN = 0.9, 0.1
#: A slot with a greater share of text in links is navigation.
MOST_LINKED = 0.5
#: Share of the varying text from which a container is the region's next step; from which what stands beside the way is content too.
TRUNK, BESIDE = 0.7, 0.2
#: Pages of which less text than this share varies are copies of each other, and what they share isn't template.
COPIES = 0.2
#: Levels of nesting that are told apart; the text runs of deeper elements are children of the one at that level, each under its own element's label.
DEPTH = 60
#: Containers of one kind below an element that are told apart: this and all later ones are one node.
ALIKE = 8
#: Hosts whose wrappers a task holds before it hands them on; partial wrappers that are merged at once.
HELD_HOSTS, FAN = 2_000, 64
#: Bytes of wrappers that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul script style noscript template textarea button iframe svg object audio video canvas".split()
)
#: A start tag of the second kind ends an open element of the first.
CLOSES = {"p": BLOCK - {"button", "iframe", "svg", "object", "audio", "video", "canvas", "script", "style", "template"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
SCOPES = frozenset("table ul ol dl article section div body main blockquote td th".split())
SILENT_TAGS = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg object audio video canvas menu dialog search fieldset legend".split())
SILENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
SILENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login menu menus modal "
    "nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related recommended reply replies respond search share sharing sidebar sidebars signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that a name may have beside those, without which it would still name the same.
PLAIN_WORDS = frozenset("area bar block box button buttons content container footer form global group head header inner item items left link links list main module outer page panel post posts right row section site thread top bottom text title wrap wrapper".split())
#: Of SILENT_NAMES, those that a section of an article may be about: inside the content they need evidence beside the name.
TOPIC_NAMES = frozenset("search share sharing social menu menus navigation widget widgets skip login subscription respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre"}
CONTAINERS = frozenset("html body div section article main center table tbody tr td ul ol dl header hgroup details".split())
#: Text blocks that a name alone doesn't silence.
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li td th dt dd tr tbody caption figcaption".split())
MAIN_TAGS, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
_WORD = re.compile(r"[a-z]+")
TEXT = "#text"


class Element:
    __slots__ = ("tag", "label", "silent", "noise", "main", "topic", "has_main", "children", "node")

    def __init__(self, tag: str, label: str, silent: bool, noise: bool, main: bool, topic: bool = False):
        self.tag, self.label, self.silent, self.noise, self.main, self.topic, self.has_main = tag, label, silent, noise, main, topic, False
        self.children: list[Element | Block] = []
        self.node: Wrapper | None = None


class Block(NamedTuple):
    """A run of text directly in a block element, between its child blocks."""

    text: str
    linked: int


@lru_cache(65_536)
def _words(name: str) -> frozenset[str]:
    return frozenset(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


@lru_cache(65_536)
def _noise(name: str) -> bool:
    """Whether a whole class or id names something that isn't content: "cookie-notice" does, "related-work" and "with-sidebar" don't."""
    words = _words(name)
    return bool(words & SILENT_NAMES) and words <= SILENT_NAMES | PLAIN_WORDS


@lru_cache(65_536)
def _topic(name: str) -> bool:
    return not _words(name) & (SILENT_NAMES - TOPIC_NAMES)


@lru_cache(65_536)
def _kind(tag: str, cls: str, name: str, role: str, hidden: bool) -> tuple[str, bool, bool, bool, bool]:
    """Label, silence, telling name, main role of an element, and whether the name may be a topic. Numbers in classes are dropped, as they tell items of one kind apart; ids tell pages apart."""
    silent = tag in SILENT_TAGS or role in SILENT_ROLES or hidden
    main = not silent and (tag in MAIN_TAGS or role in MAIN_ROLES)
    telling = [n for n in (*cls.split(), name) if _noise(n)]
    return tag + "".join("." + w for w in sorted(_words(cls))), silent, not main and bool(telling), main, all(map(_topic, telling))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", "", False, False, False)
        #: Open elements, inline ones by their name alone.
        self.open: list[Element | str] = [self.root]
        self.blocks, self.links = [self.root], 0
        #: For each of blocks: whether it is in a silent element.
        self.inside: list[bool] = [False]
        self.run: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            last, silent = self.blocks[-1], self.inside[-1]
            if text and len(self.blocks) <= DEPTH + 1:
                last.children.append(Block(text, min(self.linked, len(text))))
            elif text and not silent:
                run = Element(last.tag, last.label, False, False, any(e.main for e in self.blocks))
                run.children.append(Block(text, min(self.linked, len(text))))
                self.blocks[DEPTH].children.append(run)
            self.run, self.linked = [], 0

    def pop(self, down_to: int) -> None:
        while len(self.open) > down_to:
            last = self.open.pop()
            if isinstance(last, Element):
                self.flush()
                self.blocks.pop()
                self.inside.pop()
            elif last == "a":
                self.links -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i]
            if isinstance(at, Element):
                if tag in CLOSES.get(at.tag, ()):
                    self.pop(i)
                elif at.tag in SCOPES or at.tag in MAIN_TAGS:
                    break
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.run.append(" ")
            return
        if tag not in BLOCK:
            self.open.append(tag)
            self.links += tag == "a"
            return
        self.flush()
        got = {k: v or "" for k, v in attrs}
        label, silent, noise, main, topic = _kind(tag, got.get("class", ""), got.get("id", ""), got.get("role", "").lower(), "hidden" in got or got.get("aria-hidden") == "true")
        new = Element(tag, label, silent, noise, main, topic)
        if main:
            for e in self.blocks:
                e.has_main = True
        if len(self.blocks) <= DEPTH:
            self.blocks[-1].children.append(new)
        self.open.append(new)
        self.blocks.append(new)
        outer = tag == "header" and not any(e.main for e in self.blocks)
        self.inside.append(self.inside[-1] or silent or outer or noise and tag not in TEXT_BLOCKS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i]
            if (at.tag if isinstance(at, Element) else at) == tag:
                return self.pop(i)
            if isinstance(at, Element) and tag not in BLOCK and at.tag != "p":
                return None  # an inline end doesn't close a block
        if tag == "br":
            self.run.append(" ")
        return None

    def handle_data(self, data: str) -> None:
        self.run.append(data)
        if self.links:
            self.linked += len(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.pop(1)
    builder.flush()
    return builder.root


class Wrapper:
    """A node: its label, the pages that have it, in how many of them a text (by its hash) is in it, characters, characters in links, children in order,
    by how much a count of it is too small at most, and how many pages give it a telling name.

    told: whether with_region() has set what follows; inside: whether the region has all of it (True), leads through it (None) or doesn't touch it (False);
    mate: the node of a host's wrapper that a page's node is aligned with.
    """

    __slots__ = ("label", "pages", "shared", "chars", "linked", "children", "error", "noise", "told", "inside", "mate")

    def __init__(self, label: str, pages: int, shared: dict[int, int], chars: int, linked: int, children: list[Wrapper], error: int = 0, noise: int = 0):
        self.label, self.pages, self.shared, self.chars, self.linked, self.children, self.error, self.noise = label, pages, shared, chars, linked, children, error, noise
        self.told = False
        self.inside: bool | None = False
        self.mate: Wrapper | None = None

    def dump(self) -> list:
        return [self.label, self.pages, sorted(self.shared.items()), self.chars, self.linked, [c.dump() for c in self.children], self.error, self.noise]

    @classmethod
    def load(cls, x: list) -> Wrapper:
        return cls(x[0], x[1], dict(map(tuple, x[2])), x[3], x[4], [cls.load(c) for c in x[5]], x[6], x[7])

    def constant(self, text: int) -> bool:
        """Whether a text is in MOST_PAGES of the pages; never false where it is, and true from MOST_PAGES - FORGOTTEN on at the earliest."""
        n = self.shared.get(text, 0)
        return n > 0 and n + self.error >= MOST_PAGES * self.pages

    def own(self) -> tuple[int, int]:
        """Characters of its own text, and of that text that isn't constant; none of a slot of links."""
        if self.linked > MOST_LINKED * self.chars:
            return 0, 0
        return self.chars, self.chars - sum(n * length_of(h) for h, n in self.shared.items() if self.constant(h))

    def text(self) -> tuple[int, int]:
        """The same, here and below."""
        return tuple(map(sum, zip(self.own(), *(c.text() for c in self.children), strict=True)))


def text_hash(text: str) -> int:
    """A hash in the upper and the length, up to 65,535, in the lower bits."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 17 << 16 | min(len(text), 0xFFFF)


def length_of(text: int) -> int:
    return text & 0xFFFF


def wrapper_of(elements: list[Element]) -> Wrapper:
    """The wrapper of one page, from the root down; elements: the siblings that are one node. Silent elements are nodes without text or children."""
    first = elements[0]
    node = Wrapper(first.label, 1, {}, 0, 0, [], 0, int(first.noise))
    groups: dict[tuple[str, int], list[Element]] = {}
    seen: dict[str, int] = {}
    for e in elements:
        e.node = node
        for child in () if e.silent else e.children:
            if isinstance(child, Element):
                k = 0
                if child.tag in CONTAINERS:
                    k = seen[child.label] = min(seen.get(child.label, -1) + 1, ALIKE - 1)
                groups.setdefault((child.label, k), []).append(child)
            else:
                node.shared[text_hash(child.text)] = 1
                node.chars += len(child.text)
                node.linked += child.linked
    node.children = [wrapper_of(g) for g in groups.values()]
    return node


Pairs = list[tuple[int, int, "Pairs"]]


def match(a: Wrapper, b: Wrapper) -> tuple[int, Pairs]:
    """Simple tree matching: the nodes and equal texts of the largest matching of two trees of the same label that keeps order and ancestry; the matched children, and theirs."""
    m, n = len(a.children), len(b.children)
    table = [[0] * (n + 1) for _ in range(m + 1)]
    below: dict[tuple[int, int], tuple[int, Pairs]] = {}
    for i, x in enumerate(a.children):
        row, new = table[i], table[i + 1]
        for j, y in enumerate(b.children):
            best = row[j + 1] if row[j + 1] > new[j] else new[j]
            if x.label == y.label:
                w = below[i, j] = match(x, y) if x.children and y.children else (1 + len(x.shared.keys() & y.shared.keys()), [])
                best = max(best, row[j] + w[0])
            new[j + 1] = best
    pairs: Pairs = []
    i, j = m, n
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j, below[i, j][1]))
    return table[m][n] + 1 + len(a.shared.keys() & b.shared.keys()), pairs[::-1]


def _forget(counts: list[int], room: int) -> int:
    """The largest of the counts that may be forgotten: those up to it."""
    return max((n for n in counts if n <= room), default=0) if room > 0 else 0


def merge(a: Wrapper, b: Wrapper, pairs: Pairs | None = None) -> Wrapper:
    """Of two wrappers of one host the wrapper of all their pages."""
    children: list[Wrapper] = []
    i = j = 0
    for p, q, below in [*(match(a, b)[1] if pairs is None else pairs), (len(a.children), len(b.children), [])]:
        children += [*a.children[i:p], *b.children[j:q]]
        if p < len(a.children):
            children.append(merge(a.children[p], b.children[q], below))
        i, j = p + 1, q + 1
    more, shared = sorted((a.shared, b.shared), key=len, reverse=True)
    more = dict(more)
    for h, n in shared.items():
        more[h] = more.get(h, 0) + n
    pages, error = a.pages + b.pages, a.error + b.error
    if lost := _forget([*more.values(), *(c.pages for c in children)], int(FORGOTTEN * pages) - error):  # what is forgotten now may be in `error` pages more than counted
        more, error = {h: n for h, n in more.items() if n > lost}, error + lost
        children = [c for c in children if c.pages > lost]
    return Wrapper(a.label, pages, more, a.chars + b.chars, a.linked + b.linked, children, error, a.noise + b.noise)


def with_region(root: Wrapper) -> Wrapper:
    """The wrapper with its region of content, if it has enough pages and most of their text varies: else most of them are copies."""
    if root.told:
        return root
    root.told = True
    chars, total = root.text()
    if root.pages < MIN_PAGES or total <= COPIES * chars:
        return root
    node = root
    while node.label.split(".")[0] not in MAIN_TAGS:
        node.inside = None
        parts = [(c.text()[1], c) for c in node.children]
        trunk = next((c for n, c in parts if n >= TRUNK * total and c.label.split(".")[0] in CONTAINERS), None)
        mains = [c for n, c in parts if n >= BESIDE * total and c.label.split(".")[0] in MAIN_TAGS]
        if node.own()[1] >= BESIDE * total or trunk is None and not mains:
            break
        for n, c in parts:
            c.inside = c in mains or trunk is not None and n >= BESIDE * total and 2 * c.noise < c.pages
        if trunk is None:
            return root
        node = trunk
    node.inside = True
    return root


def _align(page: Wrapper, wrapper: Wrapper, pairs: Pairs) -> None:
    page.mate = wrapper
    for i, j, below in pairs:
        _align(page.children[i], wrapper.children[j], below)


class Found(NamedTuple):
    """A block of a page: whether it is in a main element and in the wrapper's region, its element's tag, whether it is constant in its slot, and in a slot of links."""

    text: str
    main: bool
    region: bool
    tag: str
    constant: bool
    linked: bool


def _text_of(e: Element) -> Iterator[tuple[str, Block]]:
    """The tag and the block of each text in an element that isn't silent."""
    for child in e.children:
        if isinstance(child, Block):
            yield e.tag, child
        elif not child.silent:
            yield from _text_of(child)


def _linked(e: Element) -> bool:
    blocks = [b for _, b in _text_of(e)]
    return sum(b.linked for b in blocks) > MOST_LINKED * sum(len(b.text) for b in blocks)


def _about(e: Element) -> bool:
    """Whether an element with a telling name is prose about what it names: paragraphs or headings that aren't mostly links, and nothing to fill in or press."""
    return e.topic and not _linked(e) and any(tag in PROSE for tag, _ in _text_of(e)) and not any(isinstance(c, Element) and c.tag in ("form", "button", "select") for c in e.children)


def _heads(header: Element, parent: Element) -> bool:
    """Whether a header is that of the text beside it, not the page's: below the body, with a heading that is no link, and with a text block after it."""
    if parent.tag in ("", "html", "body") or not any(tag in HEADINGS for tag, _ in _text_of(header)) or _linked(header):
        return False
    after = parent.children[parent.children.index(header) + 1 :]
    return any(isinstance(c, Element) and c.tag in PROSE for c in after)


def _blocks(page: Element, wrapper: Wrapper | None) -> list[Found]:
    own = wrapper_of([page])
    if wrapper is not None:
        _align(own, wrapper, match(own, wrapper)[1])
    out: list[Found] = []

    def visit(e: Element, main: bool, region: bool) -> None:
        mate = e.node.mate if e.node else None
        for child in e.children:
            if isinstance(child, Element):
                of = child.node.mate if child.node else None
                inside = region or bool(of and of.inside)
                leads = child.has_main or bool(of and of.inside is not False)  # never silenced by a name
                quiet = child.silent or child.tag == "header" and not (main or inside or child.main or child.has_main or _heads(child, e)) or child.noise and not leads
                if region or main:
                    quiet = child.silent or child.noise and child.tag not in TEXT_BLOCKS and not child.has_main and not _about(child)
                if not quiet:
                    visit(child, main or child.main, inside)
                continue
            constant = mate is not None and mate.pages >= MIN_PAGES and 2 * (mate.pages + wrapper.error) >= wrapper.pages and mate.constant(text_hash(child.text))
            linked, chars = (mate.linked, mate.chars) if mate else (child.linked, len(child.text))
            out.append(Found(child.text, main, region, e.tag, constant, linked > MOST_LINKED * chars))

    visit(page, False, bool(wrapper and wrapper.inside))
    return out


def _inner(found: list[Found]) -> list[Found]:
    """Blocks of the content without template: constant ones go in slots of links, and at the edges. Between varying blocks they stay, as a heading that all articles have does; and so do
    such a heading before them, and prose that is in a main element by its tag."""
    varying = [i for i, f in enumerate(found) if not f.constant]
    if not varying:
        return []
    first, last = varying[0], varying[-1]
    return [f for i, f in enumerate(found) if not f.constant or not f.linked and (i < last and (i > first or f.tag in HEADINGS) or f.main and f.tag in PROSE)]


def content(html: str, wrapper: Wrapper | None) -> list[str]:
    """The content blocks of a page, in order; wrapper: its host's. Of a page that is a copy the constant texts stay."""
    found = _blocks(parse(html), with_region(wrapper) if wrapper else None)
    if any(f.region for f in found):
        chosen = [f for f in found if f.region or f.tag == "h1" and not f.constant]
    elif any(f.main for f in found):
        chosen = [f for f in found if f.main]
    else:
        chosen = [f for f in found if not f.linked]
        chosen = [f for f in chosen if not f.constant] or chosen
    kept = _inner(chosen)
    return [f.text for f in (kept if sum(len(f.text) for f in kept) > COPIES * sum(len(f.text) for f in chosen) else chosen)]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; "" for none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


PARTIAL = "host string, wrapper string"


def _dumped(held: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.dump(), separators=(",", ":")) for w in held.values()], pa.string())], names=["host", "wrapper"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}
    for batch in slices(batches, "html"):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = wrapper_of([parse(html)])
            held[host] = merge(held[host], page) if host in held else page
            if len(held) >= HELD_HOSTS:
                yield _dumped(held)
                held = {}
    yield _dumped(held)


def _merge_rows(rows: pa.Table) -> pa.Table:
    """The wrappers of one host, two and two, so that a count is forgotten only against many pages."""
    parts = [Wrapper.load(json.loads(w)) for w in rows.column("wrapper").to_pylist()]
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    one = _dumped({rows.column("host")[0].as_py(): parts[0]})
    return pa.Table.from_batches([one]).append_column("salt", pa.array([rows.column("salt")[0].as_py()], pa.int32()))


def induce(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON), one row for each host; pages: host, html."""
    part = materialize(pages.mapInArrow(_fold, PARTIAL).withColumn("salt", F.spark_partition_id()), "wrappers")
    most = part.agg(F.max("salt")).first()[0] or 0
    while True:
        most //= FAN
        part = part.withColumn("salt", F.expr(f"salt div {FAN}").cast("int")).groupBy("host", "salt").applyInArrow(_merge_rows, f"{PARTIAL}, salt int")
        part = materialize(part, "wrappers")
        if not most:
            return part.drop("salt")


@lru_cache(256)
def _loaded(wrapper: str) -> Wrapper:
    return Wrapper.load(json.loads(wrapper))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    A null html is empty, and an empty page has the text "". A null url belongs to the host "". Rows that repeat count as pages of their own for the wrapper. Pages of
    a host with fewer than MIN_PAGES pages are told by main elements and links alone. Other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = induce(rows.select("host", "html")).withColumnRenamed("host", "_host")
    size = wrappers.agg(F.sum(64 + F.length("_host") + F.length("wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, F.col("host") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = ["\n\n".join(content(html, _loaded(w) if w else None)) for html, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", F.col("url").cast("string"), "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
