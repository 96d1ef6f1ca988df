"""Main text of web pages, with a site style tree of each host.

Every page is parsed into elements; an element's place is its path of tags and
classes from the root.  The trees of a host's pages are merged: an element node
of the merged tree knows on how many pages it occurs, and the spread of its
content and of its child layout over them.  A node's importance is

    GAMMA * H(content) + (1 - GAMMA) * H(layout),    H = entropy / log(pages)

(0 for a branch that reads the same on every page, 1 for one that differs on
each).  Branches below ``least`` are removed from every page of the host, top down,
unless they hold most of the page's main text.  Pages of a host whose whole texts are
alike count as one page, so what repeats only because the page does is no boilerplate
(a host of copies keeps its texts).  Nodes on fewer than ``min_pages`` such pages are not
judged, and nothing inside an ``article`` or ``main`` element is.

Before that, elements whose tag, role or class says so are no main text: menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments.  Their content often differs from page to page, so entropy alone
would keep them.  If a page's ``article`` or ``main`` elements hold more than half of what
is left, the text is taken from there alone.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by one newline in page order; nothing else is dropped.

Defined results: null and empty pages give an empty text; markup cut short or badly
nested is read as far as it goes; a null url's pages form a host of their own; rows
alike give like results; empty tables give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._tables import materialize
from .hostrep import host_and_path

GAMMA, LEAST, MIN_PAGES = 0.9, 0.2, 5
BROADCAST_ROWS = 200_000  # of (host, node) pairs of 16 bytes

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
BLOCK = frozenset(("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - frozenset("br option html head body td th tr tbody thead tfoot".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
NO_TEXT = frozenset(("head title script style noscript template iframe object embed canvas svg math audio video map nav footer aside form button select option "
                     "textarea input label fieldset menu dialog datalist xmp noembed noframes").split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(("ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar widget widgets menu nav navbar navigation "
                   "breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing "
                   "social related recommended recommendations comment comments commentlist replies disqus respond pagination pager copyright toolbar skip").split())
WORD_TAGS_KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
PAGE_HEADER_WORDS = frozenset(["header"])
MAIN = frozenset(["article", "main"])


@dataclass
class Node:
    path: int
    parent: int
    tag: str
    out: bool  # no main text by tag, role or class, or inside such
    main: bool  # an article or main element, or inside one
    layout: list = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, int, str]]  # node, block number, decoded text


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _no_text(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in NO_TEXT or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in WORD_TAGS_KEPT:
        return False
    names = set(_SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return bool(names & WORDS) or (not in_main and bool(names & PAGE_HEADER_WORDS))


def parse(html: str) -> Page:
    """Elements and text runs of a page, tolerant of unclosed and badly nested tags."""
    nodes = [Node(0, -1, "", False, False)]
    runs: list[tuple[int, int, str]] = []
    stack, block, at, n = [0], 0, 0, len(html)

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            runs.append((stack[-1], block, unescape(html[lo:hi])))

    def pop_to(tags, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                del stack[k:]
                return
            if tag in stop:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        close, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag in BLOCK:
            block += 1
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            pop_to({"p"}, {"article", "main", "section", "div", "td", "th", "li", "body", "table", "blockquote", "button"})
        if tag in SAME:
            pop_to(SAME[tag], SCOPE[tag])
        attrs = _attributes(raw)
        up = nodes[stack[-1]]
        mark = f"{tag}.{' '.join(sorted(attrs.get('class', '').lower().split()))}#{attrs.get('id', '').lower()}" if attrs else tag
        path = xxhash.xxh64_intdigest(mark.encode(), seed=up.path)
        in_main = up.main or tag in MAIN or attrs.get("role", "").lower() == "main"
        me = Node(path, stack[-1], tag, up.out or _no_text(tag, attrs, up.main), in_main)
        up.layout.append(path)
        nodes.append(me)
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        stack.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            stack.pop()
    return Page(nodes, runs)


def _clean(s: str) -> str:
    return " ".join(s.split())


def blocks_of(page: Page, removed: frozenset[int] = frozenset(), protect: frozenset[int] = frozenset()) -> list[tuple[str, bool]]:
    """(text, lies in article or main) of the blocks, without branches out of the text or with a path in ``removed``."""
    gone = [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):
        gone[k] = not node.main and ((k > 0 and gone[node.parent]) or (node.path in removed and k not in protect))
    off = [node.out or gone[k] for k, node in enumerate(page.nodes)]
    out, now, pieces, main = [], None, [], False
    for k, block, s in [*page.runs, (0, -1, "")]:
        if block != now:
            if pieces and (done := _clean("".join(pieces))):
                out.append((done, main))
            now, pieces, main = block, [], False
        if not off[k]:
            pieces.append(s)
            main = main or page.nodes[k].main
    return out


def _subtree_text(page: Page) -> list[int]:
    """Characters of kept text below each element."""
    size = [0] * len(page.nodes)
    for k, _, s in page.runs:
        if not page.nodes[k].out:
            size[k] += len(_clean(s))
    for k in range(len(page.nodes) - 1, 0, -1):
        size[page.nodes[k].parent] += size[k]
    return size


def main_text(page: Page, removed: frozenset[int] = frozenset()) -> str:
    protect: frozenset[int] = frozenset()
    if removed:
        size = _subtree_text(page)
        held = [k for k, x in enumerate(page.nodes) if x.path in removed]
        # an element that shares its path with others is judged by what they hold together
        by_path: dict[int, int] = {}
        for k in held:
            by_path[page.nodes[k].path] = by_path.get(page.nodes[k].path, 0) + size[k]
        protect = frozenset(k for k in held if 2 * by_path[page.nodes[k].path] > size[0] or page.nodes[k].tag in ("html", "body"))
    found = blocks_of(page, removed, protect)
    inside = [s for s, main in found if main]
    if 2 * sum(map(len, inside)) > sum(len(s) for s, _ in found):
        return "\n".join(inside)
    return "\n".join(s for s, _ in found)


def _style_nodes(batches):
    """(host, digest of the whole text, (path, content digest, layout digest) of every judged element path) of every page."""
    names = ("path", "content", "layout")
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in names]))
    for rows, _, _ in t.text_slices(batches, "html"):
        hosts = rows.column(rows.schema.get_field_index("host")).to_pylist()
        out = ([], [], [])
        for host, html in zip(hosts, rows.column(rows.schema.get_field_index("html")).to_pylist(), strict=True):
            page = parse(html or "")
            content: dict[int, list[str]] = {}
            layout: dict[int, list[int]] = {}
            texts: list[list[str]] = [[] for _ in page.nodes]
            for k, _, s in page.runs:
                if not page.nodes[k].out and not s.isspace():
                    while k > 0:  # an element's content is that of its whole branch
                        texts[k].append(s)
                        k = page.nodes[k].parent
            for k, node in enumerate(page.nodes):
                if k and texts[k] and not node.main and node.tag not in ("html", "body"):
                    content.setdefault(node.path, []).extend(texts[k])
                    layout.setdefault(node.path, []).extend(node.layout)
            if content:
                out[0].append(host)
                out[1].append(xxhash.xxh64_intdigest("\n".join(s for s, _ in blocks_of(page))) >> 1)
                out[2].append(sorted((path - (1 << 64) if path >= 1 << 63 else path, xxhash.xxh64_intdigest(_clean(" ".join(pieces))) >> 1,
                                      xxhash.xxh64_intdigest(repr(layout[path])) >> 1) for path, pieces in content.items()))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type=pa.string()), pa.array(out[1], type=pa.int64()),
                                              pa.array([[dict(zip(names, x, strict=True)) for x in nodes] for nodes in out[2]], type=kind)], names=["host", "page", "nodes"])


def low_branches(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, importance) of the nodes of each host's style tree whose importance is below ``least``.

    Pages alike are merged and digests counted per (host, node) with map-side partial results,
    so a host with a third of all pages reaches its reducers as distinct pages, then as counts.
    """
    found = pages.select("host", "html").mapInArrow(_style_nodes, "host string, page bigint, nodes array<struct<path: bigint, content: bigint, layout: bigint>>")
    # of pages alike in text the least list of nodes, whatever the order of the rows
    once = found.groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    nodes = once.select("host", F.explode("nodes").alias("e")).select("host", "e.*")
    both = nodes.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("digest")),
                                                          F.struct(F.lit(1).alias("kind"), F.col("layout").alias("digest")))).alias("d"))
    n = both.groupBy("host", "path", "d.kind", "d.digest").agg(F.count("*").cast("double").alias("n"))
    # entropy = log m - sum(n log n) / m
    h = n.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    h = h.filter(F.col("m") >= min_pages).withColumn("h", 1 - F.col("s") / (F.col("m") * F.log("m")))
    weight = F.when(F.col("kind") == 0, F.lit(GAMMA)).otherwise(F.lit(1 - GAMMA))
    out = h.groupBy("host", "path").agg(F.sum(weight * F.col("h")).alias("importance"))
    return out.filter(F.col("importance") < least)


def _extract(batches):
    for rows, _, _ in t.text_slices(batches, "html"):
        low = rows.column(rows.schema.get_field_index("low")).to_pylist()
        texts = []
        for html, paths in zip(rows.column(rows.schema.get_field_index("html")).to_pylist(), low, strict=True):
            removed = frozenset(p % (1 << 64) for p in paths or ())
            texts.append(main_text(parse(html or ""), removed))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_and_path(F.col(url))[0].alias("host"))
    low = materialize(low_branches(src, least, min_pages).select("host", "path"), "low-branches")
    per_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("low"))
    if low.count() <= BROADCAST_ROWS:
        per_host = F.broadcast(per_host)
    joined = src.join(per_host, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(_extract, f"page_id {dict(src.dtypes)['page_id']}, url string, text string, n_chars bigint")
