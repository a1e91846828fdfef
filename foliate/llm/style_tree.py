"""Operator 2: HTML extraction by site style trees.

The DOMs of one host are merged: an element node stands for all elements reached by one path, its style nodes for the
sequences of children seen below it. Importance is measured by entropy: of the styles for inner nodes (presentation), of
the text pieces, link targets and image sources for leaves (content). Branches that are unimportant from top to bottom
are cut from every page that has them.

One pass over the pages gives styles and contents together; a second one cuts, each page beside the noise of its host.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, slices

#: How fast the weight of a node's own entropy grows with its number of styles.
GAMMA = 0.9
#: Branches whose composite importance stays below this everywhere are noise.
THRESHOLD = 0.2

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: After one tag whose quotes don't close, tags of the page end at the first >, so that no text is searched twice.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg")}
ATTRIBUTE = re.compile(r"(?<![\w-])([a-zA-Z][\w-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
LOOK = ("class", "align", "bgcolor", "width")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul br".split())
#: An opening tag closes an open one of these, up to the nearest of the barriers.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_PARTS = (("p",), ("div", "article", "section", "td", "th", "li", "body", "blockquote", "form", "table"))
for _t in BLOCK - {"br"}:
    CLOSES.setdefault(_t, _PARTS)
PIECE = re.compile(r"(?<=[.!?…])\s+|[\n\r\t|•·»«]+")
SPACES, LINES = re.compile(r"\s+"), re.compile(r" ?\n[ \n]*")


class Node:
    __slots__ = ("tag", "look", "text", "target", "children", "below")

    def __init__(self, tag: str, look: str = "", text: str | None = None, target: str = ""):
        self.tag, self.look, self.text = tag, look, text
        self.target = target  # of an image its source, of others the address of the link around them
        self.children: list[Node] = []
        self.below = False  # whether it bears content


def parse(source: str | None) -> Node:
    """The DOM of a page; scripts, style sheets and comments are left out, missing end tags filled in.

    Time is linear in the length of any source: no place is searched again after a failure.
    """
    root, source = Node("#root"), source or ""
    stack, order, at, seen, tags = [root], [root], 0, 0, TAG
    opened: dict[str, list[int]] = {}  # where in the stack elements of a tag are
    last = source.rfind(">")

    def say(text: str) -> None:
        if text and not text.isspace():
            n = Node("#text", text=html.unescape(text) if "&" in text else text, target=stack[-1].target)
            n.below = True
            stack[-1].children.append(n)

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag].pop()
        del stack[k:]

    while (p := source.find("<", seen)) >= 0:
        c = source[p + 1 : p + 2]
        if c == "!" or c == "?":
            if source.startswith("<!--", p) or p < last:
                say(source[at:p])
                at = seen = COMMENT.match(source, p).end()
            else:
                seen = p + 1
            continue
        if c == "/":
            c = source[p + 2 : p + 3]
        if not ("a" <= c <= "z" or "A" <= c <= "Z"):
            seen = p + 1
            continue
        if p > last:  # tags that never end
            q = source.rfind("<")
            if source[q + 1 : q + 2].isalpha() or source[q + 1 : q + 2] == "/" and source[q + 2 : q + 3].isalpha():
                say(source[at:q])
                at = len(source)
            break
        if not (m := tags.match(source, p)):
            tags = PLAIN_TAG
            m = tags.match(source, p)
        say(source[at:p])
        at = seen = m.end()
        ending, tag, rest = m.groups()
        tag = tag.lower()
        if ending:
            if where := opened.get(tag):
                close(where[-1])
            continue
        if raw := RAW.get(tag):
            at = seen = end.end() if (end := raw.search(source, at)) else len(source)
            continue
        if (rule := CLOSES.get(tag)) and (where := max((w[-1] for x in rule[0] if (w := opened.get(x))), default=0)):
            # of several nested ones all up to the barrier are closed
            barrier = max((w[-1] for x in rule[1] if (w := opened.get(x))), default=0)
            if where > barrier:
                close(min(w[bisect_right(w, barrier)] for x in rule[0] if (w := opened.get(x)) and w[-1] > barrier))
        look, target = "", stack[-1].target
        if "=" in rest:
            had = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)}
            look = " ".join(had[x] or "" for x in LOOK if x in had)
            if tag == "a":
                target = had.get("href") or ""
            elif tag == "img":
                target = had.get("src") or ""
        if tag == "a" and "=" not in rest or tag == "img" and "=" not in rest:
            target = ""
        node = Node(tag, look, target=target)
        node.below = tag == "img" and bool(target)
        stack[-1].children.append(node)
        order.append(node)
        if tag not in VOID and rest[-1:] != "/":
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
    say(source[at:])
    for n in reversed(order):
        if not n.below:
            n.below = any(c.below for c in n.children)
    return root


def _key(*about: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, about))) - 2**63


def walk(root: Node, host: str) -> Iterator[tuple[Node, int, int, int, int, int]]:
    """(node, element key, style key, key of the element above, its number of content-bearing children, depth), parents first.

    A style key stands for the element and the sequence of its children; a leaf's is its own key.
    """
    digest = xxhash.xxh3_64_intdigest
    queue = [(root, _key(host), 0, 1, 0)]
    for node, key, above, siblings, depth in queue:
        style = key
        if node.below and node.children:
            bearing, said = [], [str(key)]
            for k, c in enumerate(node.children):
                if c.below:
                    bearing.append((k, c))
                    said.append(f"{c.tag} {c.look} 1")
                else:
                    said.append(f"{c.tag} {c.look} 0")
            style = digest("\x1f".join(said)) - 2**63
            n = len(bearing)
            for k, c in bearing:
                queue.append((c, digest(f"{style}\x1f{k}") - 2**63, key, n, depth + 1))
        yield node, key, style, above, siblings, depth


def features(node: Node) -> list[str]:
    """The content of a leaf: its text pieces, and where it links or whence its image comes."""
    own = [p for p in map(str.strip, PIECE.split(node.text)) if p] if node.text else []
    return own + (["->" + node.target] if node.target else [])


def host_of(url: str | None) -> str:
    """The host of an address, lower-case and without port; '' where there is none."""
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def host(url: Column) -> Column:
    """host_of() as a column."""
    name = F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?=[/?#:]|$)", 1)
    return F.lower(F.coalesce(F.regexp_replace(name, r"[\[\]]", ""), F.lit("")))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of styles (feature null) and of contents, summed over the pages of a slice."""
    names = ["node", "item", "content", "n", "s", "host", "above", "siblings", "depth", "leaf"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in slices(whole, 1):
            styles: Counter[tuple[int, int]] = Counter()
            about: dict[int, tuple] = {}
            contents: dict[tuple[int, int], list[float]] = {}
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not source:
                    continue
                root = parse(source)
                if not root.below:
                    continue
                own = []
                for node, key, style, above, n, depth in walk(root, h):
                    own.append((key, style))
                    if key not in about:
                        about[key] = (h, above, n, depth, key == style)
                    if key == style:
                        for f, c in Counter(features(node)).items():
                            held = contents.setdefault((key, digest(f) - 2**63), [0, 0.0])
                            held[0] += c
                            if c > 1:
                                held[1] += c * math.log(c)
                styles.update(own)
            n, m = len(styles), len(contents)
            meta = [about[key] for key, _ in styles]
            columns = [
                [k for k, _ in styles] + [k for k, _ in contents], [x for _, x in styles] + [x for _, x in contents], [False] * n + [True] * m, [*styles.values(), *(v[0] for v in contents.values())], [0.0] * n + [v[1] for v in contents.values()],
                *([x[k] for x in meta] + [None] * m for k in range(5)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def nodes(pages: DataFrame) -> DataFrame:
    """(host, node, above, depth, siblings, leaf, pages, styles, s, kinds, spread) for every node of the style trees on two pages or more.

    s: sum of n log n over the numbers n of pages of its styles; kinds: a leaf's different features; spread: the sum of their entropies.
    """
    source = pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    rows = source.mapInArrow(_trees, "node long, item long, content boolean, n long, s double, host string, above long, siblings int, depth int, leaf boolean")
    about = [F.max(c).alias(c) for c in ("host", "above", "siblings", "depth", "leaf")]  # alike in all rows of a node's styles
    items = rows.groupBy("node", "item", "content").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *about)
    style, n = ~F.col("content"), F.col("n")
    merged = items.groupBy("node").agg(*about, F.sum(F.when(style, n)).alias("pages"), F.count_if(style).alias("styles"), F.sum(F.when(style, n * F.log(n))).alias("s"), F.count_if("content").alias("kinds"), F.sum(F.when(F.col("content"), F.log(n) - F.col("s") / n)).alias("spread"))
    return merged.where("pages > 1")


def _noise(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([("depth", "ascending")])
        get = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        node, above, depth, pages, styles, leaf = (get(c) for c in ("node", "above", "depth", "pages", "styles", "leaf"))
        site, whole = np.unique(np.asarray(t.column("host").to_pylist(), dtype=object).astype(str), return_inverse=True)
        every = np.ones(len(site))
        np.maximum.at(every, whole, pages)  # a host's root is on all of its pages
        order = np.argsort(node)
        place = order[np.minimum(np.searchsorted(node, above, sorter=order), len(node) - 1)]
        up = np.where((node[place] == above) & (depth > 0), place, -1)  # a node's parent has at least its pages, so it is here too
        weight = np.where(up >= 0, pages / pages[up] / get("siblings"), 0.0)
        own = np.where(leaf, 1 - get("spread") / np.maximum(get("kinds"), 1) / np.log(every[whole]), (np.log(pages) - get("s") / pages) / np.log(pages))
        comp, below, least = np.maximum(own, 0.0), np.zeros(len(node)), np.ones(len(node))
        worst = np.zeros(len(node))  # the greatest importance in the branch
        for d in np.unique(depth)[::-1]:
            a, b = np.searchsorted(depth, [d, d + 1])
            k = np.arange(a, b)
            inner = k[~leaf[k]]
            fade = GAMMA ** styles[inner]
            comp[inner] = (1 - fade) * comp[inner] + fade * (below[inner] + np.maximum(least[inner], 0))
            # what isn't listed below a node is on one page, so it is important and so is the branch
            worst[inner] = np.maximum(worst[inner], np.where(least[inner] > 1e-9, 1.0, 0.0))
            worst[k] = np.maximum(worst[k], comp[k])
            have = k[up[k] >= 0]
            np.add.at(below, up[have], weight[have] * comp[have])
            np.add.at(least, up[have], -weight[have])
            np.maximum.at(worst, up[have], worst[have])
        bad = (worst < threshold) & (depth > 0)
        first = np.flatnonzero(bad & ~((up >= 0) & bad[up]) & ~_doomed(worst < threshold, up, depth))
        yield pa.RecordBatch.from_arrays([pa.array(site[whole[first]].tolist(), pa.string()), pa.array(node[first])], names=["host", "node"])

    return run


def _doomed(bad: np.ndarray, up: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """True below a root that is noise as a whole: its pages are copies of each other, and none of them tells a template."""
    out = bad & (depth == 0)
    for d in range(1, int(depth.max()) + 1):
        k = np.flatnonzero(depth == d)
        out[k] = (up[k] >= 0) & out[up[k]]
    return out


def noise(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, node) of the topmost noise nodes: composite importance below threshold in the node and all below it.

    A task holds the shared nodes of some hosts: their number follows the templates, not the pages.
    """
    return cut(nodes(pages), "style-nodes").repartition("host").mapInArrow(_noise(threshold), "host string, node long")


def content(root: Node, host: str, noise_nodes: set[int]) -> tuple[str, int]:
    """A page's text without noise branches, and the number of branches removed; blocks are lines."""
    bad = {id(n) for n, key, *_ in walk(root, host) if key in noise_nodes} if noise_nodes else ()
    parts, removed, stack = [], 0, [root]
    while stack:
        n = stack.pop()
        if n is None:
            parts.append("\n")
        elif n.text is not None:
            if bad and id(n) in bad:
                removed += 1
            else:
                parts.append(SPACES.sub(" ", n.text))
        elif bad and id(n) in bad:
            removed += 1
        elif n.tag in BLOCK:
            parts.append("\n")
            stack.append(None)
            stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    return LINES.sub("\n", "".join(parts)).strip(), removed


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts, removed, last, bad = [], [], None, set()
            for source, h, own in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "noise"))):
                if source is None:
                    t, r = None, 0
                else:
                    if own != last:
                        last, bad = own, set(own or ())
                    t, r = content(parse(source), h, bad)
                texts.append(t)
                removed.append(r)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "text", "removed"])


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, text, removed) for every row of pages: its text after the noise branches of its host are cut, and how many were.

    A leaf's entropy is measured against the number of its host's pages, so that what a few of many pages share stays; a host
    of one page loses nothing, nor does one whose pages are all copies of one. Null HTML gives null text, empty HTML empty
    text; a null or unreadable address belongs to the host ''. Repeated rows count as pages each and are all returned; null ids
    are carried along. Very long or ill-formed pages are parsed in linear time. An empty table gives no rows; further columns don't matter.

    Pages are joined to the list of their host's noise nodes: Spark sends the lists to the pages if they are small, and else
    exchanges pages by host, splitting hot hosts.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host"))
    bad = cut(noise(pages, threshold), "noise").groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("noise"))
    return rows.join(bad, "host", "left").select("page_id", "html", "host", "noise").mapInArrow(_extract, "page_id long, text string, removed long")
