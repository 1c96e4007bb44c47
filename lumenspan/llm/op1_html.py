"""Main text of web pages by union-free wrapper inference.

Each page is read into a tree of block elements whose leaves are texts.  Pages
of one host are aligned one after the other: where children of an element do
not match, what only one side has becomes optional (``?``), neighbours of one
kind become a repeated group (``+``), and texts become slots with statistics.
The result is a regular expression without unions, the host's wrapper.  Pages of
one structure are merged first, in any order; structures are then aligned in
the order of their hashes, over two rounds, so the wrapper does not depend on
how pages lie in partitions, and a host with a third of them costs one wrapper
per task and structure.

The wrapper's statistics decide what a page's text is (``judged``):

* the main element is the ``article`` (else ``main``) whose slots vary most from
  page to page outside links, so teasers and lists of articles lose to it; a
  host without such elements has the deepest element with most of the varying
  text;
* within it a slot that says the same on every page, a list or box at either
  end that is nearly all links, and elements whose tag, role or whole class
  names a menu, sidebar, notice, advert, form or comments are dropped.  Names
  only break ties: where they would drop nearly all that varies, the element
  that varies most is kept in spite of its name.

A page is matched with its host's wrapper, and what falls to kept slots of the
main element is its text.

Edge cases: a NULL or empty page gives an empty text; a NULL url is a host of
its own; repeated rows are extracted each; a page without a main element or with
broken markup is read as browsers do (implied ends, unknown ends ignored); a
raw element that is never closed ends at once (scripts and styles: with the
page); nesting beyond ``DEPTH`` is kept as text of the element at that depth; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, staged

#: Elements within each other that are told apart.
DEPTH = 200
#: Bytes of wrappers that are sent to every task; beyond, they are joined by host.
SENT_BYTES = 16 << 20
#: Pages that must agree before a slot's text counts as the host's own.
AGREE = 3

#: Fixed sets of HTML's elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "canvas", "object", "select", "button", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "ruby", "rt", "rp",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"html", "body", "table", "ul", "ol", "dl", "article", "section", "main", "div", "td", "th", "nav", "aside", "header", "footer", "form", "blockquote"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "button", "select"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Whole names of classes and ids that speak of no article, those that do so only together with others, and words that join them.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "responses", "sharing", "share", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "teasers", "toolbar", "topbar", "widget",
}
PARTIAL = {"reply", "replies", "respond", "search", "skip", "social", "tags", "thread", "reader", "readers", "user", "users"}
JOINING = {"area", "bar", "block", "box", "buttons", "container", "content", "feed", "field", "form", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "panel", "policy", "right", "section", "site", "slot", "text", "title", "to", "top", "bottom", "wrap", "wrapper"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PARTS = re.compile(r"[a-z]+")
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", re.I)


class Element:
    __slots__ = ("tag", "key", "kids", "dropped", "depth")

    def __init__(self, tag: str, key: str, dropped: bool, depth: int) -> None:
        self.tag, self.key, self.kids, self.dropped, self.depth = tag, key, [], dropped, depth


def _names_junk(name: str) -> bool:
    """Whether a class or id as a whole speaks of something other than the article; numbers in it don't count."""
    parts = set(_PARTS.findall(name))
    said = parts & NAMES
    return bool(parts) and parts <= NAMES | PARTIAL | JOINING and bool(said or (parts & PARTIAL and len(parts) > 1))


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's kind (tag and first class or id), and whether its tag, role or names say that it is no part of the article."""
    first, drop = "", tag in DROPPED
    for m in _ATTR.finditer(attributes):
        name, value = (m[1] or m[5] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if value.split() and not first:
                first = re.sub(r"\d+", "0", value.split()[0])
            if tag not in ("html", "body", "article", "main"):
                drop = drop or any(map(_names_junk, value.split()))
        elif name == "role":
            drop = drop or value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            drop = True
    return f"{tag}.{first}" if first else tag, drop


def parse(page: str) -> Element:
    """The page's block elements; leaves are (text, characters of it in links)."""
    root = Element("", "", False, 0)
    stack, said, links, n_links = [root], [], 0, 0

    def flush() -> None:
        nonlocal n_links
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            if text:
                stack[-1].kids.append((text, n_links))
            said.clear()
            n_links = 0

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            said.append(page[at:i])
            n_links += (i - at) * (links > 0)
        if i == n:
            break
        if page.startswith("<!--", i):
            e = page.find("-->", i + 4)
            at = n if e < 0 else e + 3
            continue
        if page.startswith(("<!", "<?"), i):
            e = page.find(">", i)
            at = n if e < 0 else e + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            said.append("<")
            at = i + 1
            continue
        rest = _REST.match(page, m.end())
        e = rest.end() if rest else page.find(">", m.end()) + 1
        at = e or n
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(links - 1, 0)
            if tag in INLINE or tag in VOID:
                continue
            for j in range(len(stack) - 1, 0, -1):
                if stack[j].tag == tag:
                    pop_to(j)
                    break
            else:
                flush()
            continue
        if tag == "br":
            said.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag in ("button", "select") and (block := _BLOCK.search(page, at, close.start() if close else n)):
                at = block.start()  # never closed: it ends where a block begins
            elif close:
                at = close.end()
            elif tag in ("script", "style", "title", "textarea"):
                at = n
            if tag not in ("svg", "math", "canvas", "audio", "video", "button", "select", "script"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            for j in range(len(stack) - 1, 0, -1):
                if stack[j].tag in CLOSES[tag]:
                    pop_to(j)
                    break
                if stack[j].tag in SCOPES - CLOSES[tag]:
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        key, drop = _describe(tag, page[m.end() : at])
        above = stack[-1]
        if tag == "header":  # a page's header; that of an article gives its headings
            drop = drop or not any(x.tag in ("article", "main") for x in stack)
        new = Element(tag, key, drop, above.depth + 1)
        if above.depth < DEPTH:
            above.kids.append(new)
        else:  # its text is the element's above; what is dropped stays dropped
            new.depth = above.depth
            new.dropped |= above.dropped
            if not new.dropped:
                new.kids = above.kids
        stack.append(new)
    flush()
    return root


# A wrapper's node is [kind, flags, pages, characters, in links, text, kids]: flags 1 optional, 2 repeated;
# for slots (kind "#") text is a hash of what all pages say there, or 0 if they differ.
KIND, FLAGS, PAGES, CHARS, LINKS, TEXT, KIDS = range(7)


def node_of(e: Element) -> list:
    kids: list[list] = []
    for k in e.kids:
        new = ["#", 0, 1, len(k[0]), k[1], zlib.crc32(k[0].encode()) + 1, []] if isinstance(k, tuple) else node_of(k)
        if kids and kids[-1][KIND] == new[KIND]:  # neighbours of one kind are a repeated group
            kids[-1] = merge(kids[-1], new, again=True)
        else:
            kids.append(new)
    return [e.key + ("!" if e.dropped else ""), 0, 1, 0, 0, 0, kids]


def _lcs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, by halving ``x`` (Hirschberg), with a row of the table at a time."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        at = np.flatnonzero(y == x[0])
        return [(0, int(at[0]))] if len(at) else []

    def last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row = np.zeros(len(b) + 1, np.int32)
        for k in a:
            row[1:] = np.maximum(row[1:], row[:-1] + (b == k))
            np.maximum.accumulate(row, out=row)
        return row

    half = len(x) // 2
    cut = int((last_row(x[:half], y) + last_row(x[half:][::-1], y[::-1])[::-1]).argmax())
    return _lcs(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _lcs(x[half:], y[cut:])]


def align(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Pairs of matching children, in order: a longest common subsequence of kinds."""
    head, tail = 0, 0
    while head < len(a) and head < len(b) and a[head][KIND] == b[head][KIND]:
        head += 1
    while tail < min(len(a), len(b)) - head and a[-1 - tail][KIND] == b[-1 - tail][KIND]:
        tail += 1
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(n[KIND], len(number)) for n in kids[head : len(kids) - tail]], np.int64) for kids in (a, b))
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in _lcs(x, y)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _optional(n: list) -> list:
    return [n[KIND], n[FLAGS] | 1, *n[2:]]


def merge(a: list, b: list, again: bool = False) -> list:
    """The least expression of this form that matches what ``a`` and ``b`` match; ``again``: both stand in one page, one after the other."""
    kids, i, j = [], 0, 0
    for p, q in [*align(a[KIDS], b[KIDS]), (len(a[KIDS]), len(b[KIDS]))]:
        for n in [*a[KIDS][i:p], *b[KIDS][j:q]]:
            if kids and kids[-1][KIND] == n[KIND]:
                kids[-1] = merge(kids[-1], _optional(n), again=True)
            else:
                kids.append(_optional(n))
        if p < len(a[KIDS]):
            both = merge(a[KIDS][p], b[KIDS][q], again)
            if kids and kids[-1][KIND] == both[KIND]:
                kids[-1] = merge(kids[-1], both, again=True)
            else:
                kids.append(both)
        i, j = p + 1, q + 1
    pages = max(a[PAGES], b[PAGES]) if again else a[PAGES] + b[PAGES]
    text = a[TEXT] if a[TEXT] == b[TEXT] else 0
    return [a[KIND], a[FLAGS] | b[FLAGS] | 2 * again, pages, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], text, kids]


def expression(n: list) -> str:
    """The wrapper as a regular expression, for reading."""
    inner = "".join(map(expression, n[KIDS]))
    body = "#" if n[KIND] == "#" else f"<{n[KIND]}>{inner}</>"
    return {0: body, 1: f"({body})?", 2: f"({body})+", 3: f"({body})*"}[n[FLAGS]]


class Judged:
    """A wrapper's node and what its host's pages say of it."""

    __slots__ = ("kind", "flags", "pages", "chars", "links", "same", "kids", "hint", "vary", "kept", "drop", "rank")

    def __init__(self, n: list) -> None:
        self.kind, self.flags, self.pages, self.chars, self.links = n[KIND], n[FLAGS], n[PAGES], n[CHARS], n[LINKS]
        self.same = bool(n[TEXT]) and n[PAGES] >= AGREE
        self.kids = [Judged(k) for k in n[KIDS]]
        self.hint, self.drop, self.rank = self.kind.endswith("!"), False, None
        if self.kind == "#":
            self.vary = 0 if self.same else max(self.chars - 2 * self.links, 0)
        else:
            self.chars, self.links, self.vary = (sum(getattr(k, x) for k in self.kids) for x in ("chars", "links", "vary"))
        self.count()

    def count(self) -> None:
        """``kept``: what varies outside elements whose names speak against them."""
        self.kept = 0 if self.hint else self.vary if self.kind == "#" else sum(k.kept for k in self.kids)

    @property
    def tag(self) -> str:
        return self.kind.rstrip("!").partition(".")[0]

    def below(self) -> Iterator[Judged]:
        """Elements below, without those of dropped ones."""
        for k in self.kids:
            if k.kind != "#":
                yield k
                if not k.hint:
                    yield from k.below()

    def trust(self, firm: frozenset[str]) -> None:
        """Keeps what varies most in spite of its name, where names would drop nearly all; elements of ``firm`` tags are dropped still."""
        if 10 * self.kept < self.vary:
            named = [k for k in self.below() if k.hint and k.tag not in firm]
            if named and 2 * (most := max(named, key=lambda k: k.vary)).vary >= self.vary:
                most.hint = False
                self.recount()

    def recount(self) -> None:
        for k in self.kids:
            if k.kind != "#":
                k.recount()
        self.count()


def _tops(n: Judged, tag: str) -> Iterator[Judged]:
    for k in n.kids:
        if k.kind != "#" and not k.hint:
            if k.tag == tag:
                yield k
            else:
                yield from _tops(k, tag)


def judged(wrapper: list) -> Judged:
    """The wrapper with its main elements ranked and, within them, what is dropped."""
    root = Judged(wrapper)
    mains = [*_tops(root, "article")] or [*_tops(root, "main")]
    for rank, n in enumerate(sorted(mains, key=lambda n: -n.kept / n.pages)):
        n.rank = rank
        n.trust(frozenset({"form", "nav", "button", "select"}))
    if not mains:
        root.trust(frozenset(DROPPED) | {"header"})
        main_of(root).rank = 0
    for n in mains or [root]:
        _judge(n, n, True)
    return root


def main_of(root: Judged) -> Judged:
    """The deepest element with most of the varying text; one that has a heading of its own is not left."""
    now, total = root, root.kept
    while total:
        best = max((k for k in now.kids if k.kind != "#"), key=lambda k: k.kept, default=None)
        if best is None or best.kept < 0.6 * total or best.tag in PARAGRAPHS or best.flags & 2 or any(k.tag in HEADINGS and k.kept for k in now.kids):
            break
        now = best
    return now


def _judge(main: Judged, n: Judged, ends: bool) -> None:
    """Marks what is dropped below ``n``; ``ends``: it is the main element, whose first and last children may be lists of links."""
    for i, k in enumerate(n.kids):
        at_end = ends and i in (0, len(n.kids) - 1)
        if k.kind == "#":
            paragraph = n.tag in HEADINGS or (n.tag in PARAGRAPHS and not (n.tag == "p" and n.drop))
            k.drop = k.same and main.vary > 0 and not paragraph
            continue
        linked = at_end and k.tag not in HEADINGS and k.tag != "p" and k.chars and 5 * k.links >= 4 * k.chars
        said_by_all = at_end and k.tag == "p" and not k.flags & 2 and main.vary > 0 and k.chars and not k.vary and not k.links
        k.drop = k.hint or bool(linked) or bool(said_by_all)
        if not k.hint:
            _judge(main, k, False)


def extract(root: Element, wrapper: Judged | None) -> str:
    """The blocks of the page that fall to kept slots of its main element, joined by an empty line; without a wrapper all blocks."""

    def matched(e: Element, w: Judged | None) -> Iterator[tuple[Element | tuple[str, int], Judged | None]]:
        """The page's children with the wrapper's that they fall to: the next of the kind, or the first."""
        kids, at = w.kids if w else [], 0
        for k in e.kids:
            kind = "#" if isinstance(k, tuple) else k.key + ("!" if k.dropped else "")
            i = next((i for i in [*range(at, len(kids)), *range(min(at, len(kids)))] if kids[i].kind == kind), None)
            at = at if i is None else i
            yield k, None if i is None else kids[i]

    found: list[tuple[int, Element, Judged | None]] = []

    def search(e: Element, w: Judged | None) -> None:
        if w is not None and w.rank is not None:
            found.append((w.rank, e, w))
            return
        for k, kid in matched(e, w):
            if isinstance(k, Element) and not (kid and kid.hint):
                search(k, kid)

    search(root, wrapper)
    best = min((r for r, _, _ in found), default=None)
    mains = [(e, w) for r, e, w in found if r == best] if found else [(root, None)]

    def take(e: Element, w: Judged | None, headings_only: bool, blocks: list[str]) -> None:
        for k, kid in matched(e, w):
            if isinstance(k, tuple):
                if not (kid and kid.drop) and (not headings_only or e.tag in HEADINGS):
                    blocks.append(k[0])
            elif not (kid and kid.drop):
                take(k, kid, headings_only or k.tag == "header", blocks)

    texts: list[list[str]] = []
    for e, w in mains:
        texts.append([])
        take(e, w, False, texts[-1])
    size = [sum(map(len, t)) for t in texts]
    if len(texts) > 1 and 3 * max(size) >= 2 * sum(size):  # an article among teasers of its kind
        texts = [texts[size.index(max(size))]]
    return "\n\n".join(x for t in texts for x in t)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def structure_of(n: list) -> int:
    """A hash of what the wrapper's expression is, whatever its texts."""
    return int.from_bytes(hashlib.blake2b(expression(n).encode(), digest_size=8).digest(), "big", signed=True)


def _rows(items: Iterator[tuple[str, int, list]]) -> Iterator[pa.RecordBatch]:
    got = [(h, k, json.dumps(w, separators=(",", ":"))) for h, k, w in items]
    for i in range(0, len(got), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[i : i + 256]), (pa.string(), pa.int64(), pa.string()))], ["host", "structure", "wrapper"])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """One wrapper per host, from rows sorted by (host, structure): equal structures are merged first, then structures are aligned in order."""
    host, whole, key, part = None, None, 0, None
    for b in batches:
        for h, k, w in zip(*(b.column(i).to_pylist() for i in range(3))):
            w = json.loads(w)
            if h == host and k == key:
                part = merge(part, w)
                continue
            if part is not None:
                whole = part if whole is None else merge(whole, part)
                if h != host:
                    yield host, 0, whole
                    whole = None
            host, key, part = h, k, w
    if part is not None:
        yield host, 0, part if whole is None else merge(whole, part)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = 512) -> DataFrame:
    """(host, wrapper): the wrapper that all pages of each host give, as JSON."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for b in batches:
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = node_of(parse(h or ""))
                at = host_of(u), structure_of(n)
                held[at] = merge(held[at], n) if at in held else n
                if len(held) > most:
                    yield from _rows((*k, w) for k, w in held.items())
                    held = {}
        yield from _rows((*k, w) for k, w in held.items())

    schema, salt = "host string, structure long, wrapper string", F.pmod("structure", F.lit(32))

    def fold(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
        yield from _rows((h.partition("\0")[2], int(h.partition("\0")[0]), w) for h, _, w in _ordered(batches)) if salted else _rows(_ordered(batches))

    got = pages.select(url_col, html_col).transform(in_arrow, first, schema)
    parts = got.select(F.concat_ws("\0", salt.cast("string"), "host").alias("host"), "structure", "wrapper")
    got = parts.repartition("host").sortWithinPartitions("host", "structure", "wrapper").transform(in_arrow, lambda b: fold(b, True), schema)
    return got.repartition("host").sortWithinPartitions("host", "structure").transform(in_arrow, lambda b: fold(b, False), schema).drop("structure")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = staged(wrappers(pages, url_col, html_col), "wrappers")
    size = known.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sent = {r["host"]: json.loads(r["wrapper"]) for r in known.collect()} if size <= SENT_BYTES else None
    if sent is None:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
        rows = rows.withColumn("host", host).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Judged] = {}
        for b in batches:
            urls, out = b.column(1).to_pylist(), []
            own = b.column(3).to_pylist() if sent is None else [None] * b.num_rows
            for u, h, w in zip(urls, b.column(2).to_pylist(), own):
                host = host_of(u)
                if host not in known:
                    if len(known) > 512:
                        known.clear()
                    w = json.loads(w) if w else (sent or {}).get(host)
                    known[host] = judged(w) if w else None
                out.append(extract(parse(h or ""), known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.transform(in_arrow, run, "page_id long, url string, text string, n_chars long")
