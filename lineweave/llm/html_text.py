"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of style nodes (the path of block elements with their
class and id words).  Over the host's pages a node's presentation importance is the entropy of
the child sequences it has, and its content importance is one minus the mean entropy of the text
units below it: what stands on every page alike tells nothing.  Their mean is the node's
importance, and a branch goes if importance times the weight of its declared role is under
THRESHOLD.  Weights (``WEIGHTS``): navigation, headers, footers, sidebars, notices, adverts, forms,
comments and hidden elements 0, elements whose class merely has such a word in it 1, undeclared ones
1.5, those at or under a declared article 3.  So the style tree decides everywhere but below
elements that say that they are not the article; adverts need that, as they differ from page to
page.  Hosts with fewer than MIN_PAGES pages showing a node cannot judge it; its importance is one.
Pages of a host with the same text (copies of one article) count once.

Where a page declares its article, what lies outside is not the article, unless the important text
outside is longer (then the declared ones are teasers).  If the tree would remove more than half of a
declared article, it has nothing to compare it with (near copies on the host), and the article stays.

Defined results: null html counts as empty and gives an empty text; pages without a host are judged
by declared roles alone; a page that would lose everything keeps its undeclared branches; elements may
be nested to any depth (style nodes end at depth DEPTH, roles do not); ``<svg/>`` is empty, and so is an
unclosed element whose content is left out, except scripts, styles, titles and text areas, which reach
to the end of the page as in browsers; repeated rows give equal results each; ids stay as they are, null
ones too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expect_columns, stored

THRESHOLD = 0.3
MIN_PAGES = 5
#: Low-importance nodes (8 bytes each) that are sent to every task; more of them are joined instead.
BROADCAST_NODES = 200_000

# HTML elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text to the parser, and those whose content is no part of the text.
RAW_TEXT = set("script style title textarea iframe".split())
NO_TEXT = RAW_TEXT | set("noscript template object svg math canvas audio video select".split())
OPEN_ENDED = RAW_TEXT - {"iframe"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLING_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = set("ul ol menu dl table tbody thead tfoot article section div body".split())
# What markup says about a branch.
DROP_TAGS = set("head nav footer aside form button menu dialog search fieldset label legend".split())
DROP_ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
DROP_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login sidebar rail widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist discussion disqus respond replies reply nav "
    "navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar copyright "
    "disclaimer search form paywall".split()
)
#: Words that a class name may have beside those without changing what it says.
NEUTRAL_WORDS = set(
    "site page main top bottom left right center inner outer wrap wrapper container box block area section list item "
    "items button buttons link links bar panel content group title heading slot unit primary secondary global sticky "
    "fixed mobile desktop row col column body text post posts user users entry article articles story module zone "
    "region header small large".split()
)
HEAD_WORDS = {"header"}
MAIN_TAGS = {"article", "main"}
MAIN_ROLES = {"main", "article"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORD = re.compile(r"[A-Za-z]+|(?<![0-9])[0-9](?![0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display:none|visibility:hidden")

KEEP, DROP, MAIN, SUSPECT = range(4)
#: What importance is multiplied with, by role.
WEIGHTS = {KEEP: 1.5, DROP: 0.0, MAIN: 3.0, SUSPECT: 1.0}
#: Elements nested deeper have no style node of their own.
DEPTH = 400


def class_role(names: str) -> int:
    """What a class attribute or an id says: DROP if one of its names has only words that say so (neutral ones aside),
    SUSPECT if a name has such a word among others."""
    role = KEEP
    for name in names.split():
        words = {w.lower() for w in WORD.findall(CAMEL.sub(" ", name))}
        if words & DROP_WORDS:
            if all(w in DROP_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
                return DROP
            role = SUSPECT
    return role


def attributes_of(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values, bare in ATTRIBUTE.findall(raw):
        found.setdefault((name or bare).lower(), unescape(next((v for v in values if v), "")))
    return found


def says_drop(attributes: dict[str, str]) -> bool:
    """Whether an element of any kind is hidden or declared to be no part of the article."""
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or bool(HIDDEN.search(attributes.get("style", "").replace(" ", "").lower()))
        or bool(set(attributes.get("role", "").lower().split()) & DROP_ROLES)
    )


class _Node:
    __slots__ = ("chain", "children", "in_main", "role", "tag")

    def __init__(self, tag: str, chain: tuple[tuple[int, int], ...], role: int, in_main: bool) -> None:
        #: Style nodes from the root (or from the declared article) down, each with its role.
        self.tag, self.chain, self.role, self.in_main = tag, chain, role, in_main
        self.children: list[str] = []


class Page:
    """Text units of one page, each with the style nodes above it, and the child sequences of all nodes."""

    def __init__(self, html: str) -> None:
        #: (text, chain of (style node, role) from the root, role)
        self.units: list[tuple[str, tuple[tuple[int, int], ...], int]] = []
        #: (chain of a node, hash of its child sequence)
        self.shapes: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self.has_main = False
        self._buffer: list[str] = []
        #: An inline element whose text is left out: its name, how often it is open, the blocks open around it.
        self._mute: tuple[str, int, int] | None = None
        self._stack = [_Node("", ((_hash("/"), KEEP),), KEEP, False)]
        self._open: Counter = Counter()
        self._parse(html)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer = []
            if text:
                top = self._stack[-1]
                role = DROP if top.role == DROP else MAIN if top.in_main else KEEP
                self.units.append((text, top.chain, role))

    def _pop(self) -> None:
        self._flush()
        node = self._stack.pop()
        self._open[node.tag] -= 1
        if self._mute and len(self._stack) < self._mute[2]:
            self._mute = None
        if len(self._stack) <= DEPTH:
            self.shapes.append((node.chain, _hash(" ".join(node.children))))

    def _close(self, names: set[str], scopes: set[str]) -> None:
        """End the innermost open element of these names, unless a scope is nearer."""
        if not any(self._open[n] for n in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag in names:
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in scopes:
                return

    def _parse(self, html: str) -> None:
        at = 0
        #: Names of which no end tag follows any more.
        ended: set[str] = set()
        while True:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2] or m[4]:
                tag, raw = (m[2] or m[4]).lower(), m[3] or m[5] or ""
                if tag not in NO_TEXT:
                    self._start(tag, raw)
                elif not (raw.endswith("/") and tag in ("svg", "math")):
                    end = None if tag in ended else _end_of(html, tag, at)
                    if end is not None:
                        at = end
                    elif tag in OPEN_ENDED:
                        at = len(html)
                    else:
                        ended.add(tag)
        while len(self._stack) > 1:
            self._pop()
        self._flush()
        self.shapes.append((self._stack[0].chain, _hash(" ".join(self._stack[0].children))))

    def _text(self, text: str) -> None:
        if text and not self._mute:
            self._buffer.append(unescape(text) if "&" in text else text)

    def _inline(self, tag: str, raw: str) -> None:
        if self._mute:
            if tag == self._mute[0] and not raw.endswith("/"):
                self._mute = (tag, self._mute[1] + 1, self._mute[2])
        elif raw and not raw.endswith("/"):
            attributes = attributes_of(raw)
            named = [class_role(attributes[c]) for c in ("class", "id") if c in attributes]
            if says_drop(attributes) or DROP in named:
                self._mute = (tag, 1, len(self._stack))

    def _start(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            self._inline(tag, raw)
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text(" ")
            return
        self._flush()
        if tag == "body":
            self._close({"head"}, set())
        if tag in CLOSES_PARAGRAPH:
            self._close({"p"}, SCOPES - {"p"})
        if tag in SIBLING_ENDS:
            self._close(SIBLING_ENDS[tag], SCOPES)
        attributes = attributes_of(raw) if raw else {}
        words = [w.lower() for c in ("class", "id") if c in attributes for w in WORD.findall(CAMEL.sub(" ", attributes[c]))]
        parent = self._stack[-1]
        role, in_main = self._role(tag, attributes, set(words), parent)
        name = ".".join([tag, *words])
        if len(self._stack) < DEPTH:
            parent.children.append(name)
            chain = (*parent.chain, (_hash(f"{parent.chain[-1][0]} {name}"), MAIN if in_main and role == KEEP else role))
        else:
            chain = parent.chain
        self._stack.append(_Node(tag, chain, role, in_main))
        self._open[tag] += 1

    def _role(self, tag: str, attributes: dict[str, str], words: set[str], parent: _Node) -> tuple[int, bool]:
        if parent.role == DROP:
            return DROP, parent.in_main
        named = [class_role(attributes[c]) for c in ("class", "id") if c in attributes and tag not in ("html", "body")]
        if tag in DROP_TAGS or says_drop(attributes) or DROP in named:
            return DROP, parent.in_main
        if (tag == "header" or words & HEAD_WORDS) and not parent.in_main and tag not in ("html", "body", *MAIN_TAGS):
            return DROP, False
        role = SUSPECT if SUSPECT in named else KEEP
        declared = set(attributes.get("role", "").lower().split())
        if tag in MAIN_TAGS or declared & MAIN_ROLES or attributes.get("itemprop", "").lower() == "articlebody":
            self.has_main = True
            return KEEP, True
        return role, parent.in_main

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if self._mute and tag == self._mute[0]:
                name, times, blocks = self._mute
                self._mute = (name, times - 1, blocks) if times > 1 else None
            return
        if tag in VOID or tag in NO_TEXT:
            if tag == "br":
                self._text(" ")
            return
        self._close({tag}, {"article", "section", "nav", "aside"} - {tag} if tag in ("p", "li") else set())

    def mark(self) -> int:
        """Equal for pages with the same text in their declared article, or the same undropped text if they have none."""
        state = xxhash.xxh64()
        wanted = MAIN if self.has_main else KEEP
        for text, _, role in self.units:
            if role == wanted:
                state.update(text.encode("utf-8", "surrogatepass") + b"\n")
        return state.intdigest()

    def text(self, importance) -> str:
        """Units that no node of little weighted importance is above of; ``importance`` tells of a style node."""

        def low(chain: tuple[tuple[int, int], ...], inside: bool) -> bool:
            # of a declared article, only what is at or under it is asked
            return any(
                importance(style) * WEIGHTS[role] < THRESHOLD
                for style, role in chain
                if not inside or role == MAIN or role == SUSPECT
            )

        free = [(t, chain) for t, chain, role in self.units if role == KEEP]
        free_kept = [t for t, chain in free if not low(chain, False)]
        if self.has_main:
            main = [(t, chain) for t, chain, role in self.units if role == MAIN]
            kept = [t for t, chain in main if not low(chain, True)]
            if 2 * sum(map(len, kept)) < sum(len(t) for t, _ in main):
                kept = [t for t, _ in main]
            if sum(map(len, kept)) >= sum(map(len, free_kept)):
                return " ".join(kept)
        return " ".join(free_kept or [t for t, _ in free])


_TAGS: dict[str, re.Pattern] = {}


def _end_of(html: str, tag: str, at: int) -> int | None:
    """Where the end tag of an element begins that was opened before ``at``; None if there is none."""
    if tag not in _TAGS:
        _TAGS[tag] = re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE | re.ASCII)
    open_ = 1
    first = None
    for m in _TAGS[tag].finditer(html, at):
        if m[1]:
            first = m.start() if first is None else first
            open_ -= 1
            if not open_ or tag in RAW_TEXT:
                return m.start()
        else:
            open_ += 1
    return first


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _node(host: int, style: int) -> int:
    """The key of a style node of a host."""
    x = (host ^ (style * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >= 1 << 63 else x


_FEATURES = "node long, kind int, feature long, mark long"
#: Kinds of features: a text unit right in a node, a child sequence, a node above (or the node itself).
UNIT, SHAPE, ABOVE = 0, 1, 2
#: Features sent on at once.
FLUSH = 200_000


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the nodes of all pages, each with the mark of its page; repeats included."""
    names = ["node", "kind", "feature", "mark"]
    out: list[tuple[int, int, int, int]] = []
    known: set[int] = set()

    def done() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
        arrays += [pa.array(np.array(columns[k], dtype=np.uint64).view(np.int64)) for k in (2, 3)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            if not host or not html:
                continue
            h, page = _hash(host), Page(html)
            mark = page.mark()
            for chain, shape in page.shapes:
                node = _node(h, chain[-1][0])
                out.append((node, SHAPE, shape, mark))
                if node not in known:
                    known.add(node)
                    out.extend((node, ABOVE, _node(h, style) & 0xFFFFFFFFFFFFFFFF, 0) for style, _ in chain)
                if len(out) > FLUSH:
                    yield done()
            for text, chain, _ in page.units:
                out.append((_node(h, chain[-1][0]), UNIT, _hash(text), mark))
                if len(out) > FLUSH:
                    yield done()
            if len(known) > FLUSH:
                known.clear()
    if out:
        yield done()


def node_importance(pages: DataFrame) -> DataFrame:
    """(node, pages, importance) of every style node of every host of ``pages`` (url, html)."""
    counts = (
        expect_columns(pages, "url", "html")
        .mapInArrow(_features, _FEATURES)
        .distinct()  # copies of a page count once
        .groupBy("node", "kind", "feature")
        .agg(F.count("*").alias("n"))
    )
    n = F.col("n").cast("double")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    nodes = stored(
        counts.groupBy("node").agg(
            F.sum(of(SHAPE, n)).alias("shown"),
            # sum of p * ln(p) = sum(n * ln n) / N - ln N
            F.sum(of(SHAPE, n * F.log(n))).alias("shape_sum"),
            F.sum(of(UNIT, F.log(n))).alias("unit_sum"),
            F.count(of(UNIT, n)).alias("units"),
            F.collect_set(of(ABOVE, F.col("feature"))).alias("above"),  # DEPTH at most
        )
    )
    below = (
        nodes.where("units > 0")
        .select(F.explode("above").alias("node"), "unit_sum", "units")
        .groupBy("node")
        .agg((F.sum("unit_sum") / F.sum("units")).alias("unit_mean"))
    )
    size = F.log(F.greatest(F.col("shown"), F.lit(2.0)))
    presentation = F.greatest(F.lit(0.0), F.log("shown") - F.col("shape_sum") / F.col("shown")) / size
    content = F.greatest(F.lit(0.0), 1 - F.col("unit_mean") / size)
    return nodes.join(below, "node", "left").where("shown > 0").select(
        "node",
        F.col("shown").cast("long").alias("pages"),
        F.when(F.col("shown") < MIN_PAGES, 1.0)
        .when(F.col("unit_mean").isNull(), presentation)
        .otherwise((presentation + content) / 2)
        .alias("importance"),
    )


def _extract(low_nodes: dict[int, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            rows = batch.column("low").to_pylist() if low_nodes is None else [None] * batch.num_rows
            for url, html, mine in zip(
                batch.column("url").to_pylist(), batch.column("html").to_pylist(), rows, strict=True
            ):
                host = host_of(url)
                nodes = low_nodes if low_nodes is not None else {x["node"]: x["importance"] for x in mine or ()}
                h = _hash(host) if host else None

                def importance(style: int, h=h, nodes=nodes) -> float:
                    return 1.0 if h is None else nodes.get(_node(h, style), 1.0)

                texts.append(Page(html).text(importance) if html else "")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The style nodes of every page."""
    for batch in batches:
        for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_key", "url", "html")), strict=True):
            host = host_of(url)
            if host and html:
                h = _hash(host)
                mine = list({_node(h, chain[-1][0]) for chain, _ in Page(html).shapes})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(mine), pa.int64()), pa.array(mine, pa.int64())], names=["page_key", "node"]
                )


def html_text(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): text and n_chars."""
    rows = expect_columns(pages, "page_id", "url", "html")
    # no weight but zero is under one: nodes of THRESHOLD or more never go
    low = node_importance(rows).where(F.col("importance") < THRESHOLD).select("node", "importance")
    found = low.limit(broadcast_nodes + 1).toArrow()
    result = "page_id long, url string, text string, n_chars long"
    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    if found.num_rows <= broadcast_nodes:
        return rows.mapInArrow(_extract(dict(zip(*found.to_pydict().values(), strict=True))), result)
    low = stored(low)
    keyed = rows.withColumn("page_key", F.xxhash64("url", "html"))
    mine = (
        keyed.mapInArrow(_chains, "page_key long, node long")
        .distinct()
        .join(low, "node")
        .groupBy("page_key")
        .agg(F.collect_list(F.struct("node", "importance")).alias("low"))
    )
    return keyed.join(mine, "page_key", "left").select("page_id", "url", "html", "low").mapInArrow(_extract(None), result)
