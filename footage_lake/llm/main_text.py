"""HTML extraction: the main text of pages by gradient-boosted trees over DOM nodes.

Each block element and each run of text between block borders is a node with
features: its kind, what its class, id and role say, depth, text and link density of
its subtree, and how it compares with its siblings. The trees give each node log-odds
of being content. Choices are then made from the root down so that the sum of
log-odds is highest under one rule: below a rejected node nothing is kept.

The trees are trained on the driver from a bounded sample of pages that mark their
article, and on pages composed from the same paragraphs in other layouts, so that
neither a tag nor a class name alone decides.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import thinned

#: Pages that the trees are trained on, at most, and pages composed from them.
SAMPLE, COMPOSED = 150, 500
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
#: Characters of the training pages together, at most: pages are taken in the order of a hash until they reach it.
SAMPLE_CHARS = 8_000_000

# Element names of HTML and words that class, id and role attributes use.
RAW = set("script style noscript iframe textarea title".split())  # text up to the end tag
REJECTED = set("template svg canvas video audio select button datalist".split())  # elements that may hold others
NESTED = set("template svg".split())  # of these, those that may hold one of their own name
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose mtable mtr mtd".split()
)
GROUPS = {
    "paragraph": "p blockquote pre dd dt figcaption",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu",
    "item": "li",
    "article": "article main",
    "nav": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form fieldset",
    "table": "table tbody thead tfoot tr td th caption",
    "box": "div section body html center figure details summary address",
}
GOOD = set("article content main post entry story body text prose copy".split())
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager skip toc".split(),
    "top": "header masthead topbar branding logo hero site".split(),
    "bottom": "footer foot copyright colophon legal bottom".split(),
    "side": "sidebar side aside widget widgets related recommended trending popular rail more".split(),
    "advert": "ad ads adv advert advertisement adverts banner promo promotion sponsor sponsored sponsors".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message paywall disclaimer".split(),
    "form": "form search login signup subscribe newsletter contact share sharing social".split(),
    "reader": "comment comments reply replies respond disqus discussion feedback reviews thread author-box".split(),
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "menu"}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|$)|[!?/][^>]*(?:>|$))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|data-truth)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+(?:-box)?")
_KIND = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags.split()}
_TEXT = len(GROUPS)
#: Place of an ancestor's kind among the features of what is above a node.
_ABOVE = {tag: j for j, k in enumerate(("article", "nav", "header", "footer", "aside", "form"), 2) for tag in GROUPS[k].split()}


@dataclass
class Node:
    tag: str
    up: int
    depth: int
    tokens: frozenset = frozenset()
    truth: str | None = None
    kids: list[int] = field(default_factory=list)
    text: str = ""
    link: int = 0


def parse(page: str | None, composed: bool = False) -> list[Node]:
    """Nodes in page order, parents first; the root is an empty box. A null page is empty.

    Only pages that ``composed`` made say of their elements what is content. The time
    is linear in the page: where the open elements of a name are, and which open element
    is the innermost block, is kept while they open and close.
    """
    page = page or ""
    nodes = [Node("body", -1, 0)]
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and the node that holds their text
    run: list[str] = []
    links = [0, 0]  # open links, characters inside them in the run
    quiet = 0  # place in the stack of the outermost rejected element, 0: none is open
    ends: dict[str, tuple[int, bool]] = {}  # per rejected name, where its next tag is and whether it is an end tag
    places: dict[str, list[int]] = {}  # per name, places in the stack of its open elements
    blocks: list[int] = []  # places in the stack of the open elements that are not inline
    headless = False  # no end of a head lies ahead

    def push(tag: str, owner: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, owner))

    def ended(tag: str, start: int) -> bool:
        """Whether the element that starts before ``start`` has an end tag."""
        place, closes = ends.get(tag, (-1, False))
        if place < start:
            nested = tag in NESTED
            found = re.compile(f"</{tag}\\b" if nested else f"</?{tag}\\b", re.I).search(page, start)
            place, closes = (found.start(), found.group(0)[1] == "/") if found else (len(page), False)
            ends[tag] = place, closes
        return closes

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            owner = stack[-1][1]
            nodes.append(Node("#text", owner, nodes[owner].depth + 1, text=text, link=min(links[1], len(text))))
            nodes[owner].kids.append(len(nodes) - 1)
        run.clear()
        links[1] = 0

    def say(raw: str) -> None:
        if raw and not quiet:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if links[0]:
                links[1] += len(text.strip())

    def close(k: int) -> None:
        """Close the open elements from number ``k`` on."""
        nonlocal quiet
        heard = stack[k:quiet] if quiet else stack[k:]
        if any(t not in INLINE for t, _ in heard):
            flush()
        links[0] -= sum(t == "a" for t, _ in heard)
        for t, _ in stack[k:]:
            places[t].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]
        if k <= quiet:
            quiet = 0

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        closing, tag, attrs = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            k = places[tag][-1] if places.get(tag) else 0
            held = () if tag in INLINE or tag in _KIND else HOLDERS  # an unknown name does not end a list or table
            if k and not any(places.get(t) and places[t][-1] > k for t in held):
                close(k)
            continue
        if tag == "head":
            after = at if headless else _head_end(page, at)
            headless, at = after == at, after
            continue
        if tag in RAW and not (quiet and attrs.endswith("/")):
            stop = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if quiet or tag in REJECTED:
            own = not attrs.endswith("/") and tag not in VOID
            if own and (tag not in REJECTED or ended(tag, at)):
                quiet = quiet or len(stack)
                push(tag, stack[-1][1])
            continue
        if tag == "math" and attrs.endswith("/"):
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links[0] += 1
            push(tag, stack[-1][1])
            continue
        if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in CLOSES.get(tag, ())):
            close(blocks[-1])  # this element ends it by starting
        flush()
        said = {a.lower(): (v or "").strip("\"'").lower() for a, v in _ATTR.findall(attrs)} if attrs and "=" in attrs or "hidden" in (attrs or "") else {}
        if "hidden" in said:
            said["class"] = said.get("class", "") + " popup"
        tokens = frozenset(t for a in ("class", "id", "role", "aria-label") if a in said for t in _TOKEN.findall(said[a]))
        owner = stack[-1][1]
        nodes.append(Node(tag, owner, nodes[owner].depth + 1, tokens, said.get("data-truth") if composed else None))
        nodes[owner].kids.append(len(nodes) - 1)
        push(tag, len(nodes) - 1)
    flush()
    return nodes


_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)


def _head_end(page: str, at: int) -> int:
    """Where the head ends: behind its end tag, or at the body; without both, nothing is skipped."""
    found = _HEAD_END.search(page, at)
    if found is None:
        return at
    return found.end() if found.group(0)[1] == "/" else found.start()


NAMES = (
    [f"is_{k}" for k in GROUPS] + ["is_text", "good"] + [f"bad_{k}" for k in BAD]
    + ["above_good", "above_bad", "in_article", "in_nav", "in_top", "in_bottom", "in_aside", "in_form", "depth", "log_text", "link_share", "density", "log_tags"]
    + ["marks", "page_share", "place", "siblings", "of_sibling_text", "of_parent", "paragraphs", "words_a_run"]
)


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    size, link, tags, marks, paragraphs, runs = (np.zeros(n) for _ in range(6))
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        size[k] += len(x.text)
        link[k] += x.link
        tags[k] += 1
        if x.text:
            marks[k] += x.text.count(",") + x.text.count(".") + x.text.count(";")
            runs[k] += 1
        paragraphs[k] += x.tag in ("p", "blockquote", "pre")
        if x.up >= 0:
            for a in (size, link, tags, marks, paragraphs, runs):
                a[x.up] += a[k]
    before = np.zeros(n)
    seen = 0.0
    out = np.zeros((n, len(NAMES)))
    bad_words = list(BAD.values())
    first = len(GROUPS) + 1
    state = np.zeros((n, 8))  # above_good .. in_form
    for k, x in enumerate(nodes):
        before[k] = seen
        seen += len(x.text)
        row = out[k]
        row[_TEXT if x.tag == "#text" else _KIND.get(x.tag, _KIND["div"])] = 1
        if x.tokens:
            row[first] = not x.tokens.isdisjoint(GOOD)
            for j, words in enumerate(bad_words):
                row[first + 1 + j] = not x.tokens.isdisjoint(words)
        if x.up >= 0:
            s = state[k]
            s[:] = state[x.up]
            p = out[x.up]
            s[0] = max(s[0], p[first])
            s[1] += bool(nodes[x.up].tokens) and p[first + 1 : first + 1 + len(BAD)].any()
            above = _ABOVE.get(nodes[x.up].tag)
            if above is not None:
                s[above] = 1
    total = max(size[0], 1.0)
    at = first + 1 + len(BAD)
    up = np.array([max(x.up, 0) for x in nodes])
    n_kids = np.array([len(x.kids) for x in nodes], float)
    largest = np.zeros(n)
    np.maximum.at(largest, up[1:], size[1:])
    out[:, at : at + 8] = state
    rest = [
        np.array([x.depth for x in nodes], float), np.log1p(size), link / np.maximum(size, 1), size / tags, np.log1p(tags),
        marks / np.maximum(size, 1) * 100, size / total, before / total, n_kids[up], size / np.maximum(largest[up], 1), size / np.maximum(size[up], 1),
        paragraphs, size / np.maximum(runs, 1),
    ]
    out[:, at + 8 :] = np.stack(rest, axis=1)
    return out


@dataclass
class Trees:
    """Boosted trees of one depth: per tree the tests of its inner nodes and the values of its leaves."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Gradient boosting of the logistic loss; splits at quantile bins by the usual gain."""
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T, strict=True)], axis=1)
    share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    out = Trees(math.log(share / (1 - share)), np.zeros((trees, 2**DEPTH - 1), int), np.full((trees, 2**DEPTH - 1), np.inf), np.zeros((trees, 2**DEPTH)))
    raw = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(len(y), int)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.full(width, 1e-6)
            for f, b in enumerate(bounds):
                if not len(b):
                    continue
                key = slot * (len(b) + 1) + binned[:, f]
                gs = np.bincount(key, g, width * (len(b) + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (len(b) + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 0.5) | (ha - hl < 0.5)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for s in np.flatnonzero(top > best):
                    best[s], out.feature[t, first + s], out.bound[t, first + s] = top[s], f, b[k[s]]
            at = 2 * at + 1 + (x[np.arange(len(x)), out.feature[t, at]] > out.bound[t, at])
        slot = at - (2**DEPTH - 1)
        out.leaf[t] = RATE * np.bincount(slot, g, 2**DEPTH) / (np.bincount(slot, h, 2**DEPTH) + 1)
        raw += out.leaf[t][slot]
    return out


def decoded(nodes: list[Node], odds: np.ndarray) -> str:
    """Kept runs in page order: highest sum of log-odds, nothing kept below a rejected node."""
    keep, drop = odds.copy(), -odds
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].up
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True
    out = []
    for k in range(1, len(nodes)):
        chosen[k] = chosen[nodes[k].up] and keep[k] > drop[k]
        if chosen[k] and nodes[k].text:
            out.append(nodes[k].text)
    return " ".join(out)


# Words of attributes that say of a part of an article that it is none of its text.
APART = set(
    "nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended trending popular"
    " ad ads adv advert advertisement adverts banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr popup modal overlay paywall disclaimer"
    " form search login signup subscribe newsletter share sharing social comment comments reply replies respond disqus discussion feedback copyright".split()
)


def truths(nodes: list[Node]) -> np.ndarray:
    """1 for nodes in an article (or marked so) and for those above kept text; 0 for the rest.

    Menus, forms, side matter, footers and what its attributes name as advert, notice,
    share bar or reader comments are no content inside an article either.
    """
    own, lost = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for k, x in enumerate(nodes):
        inside = own[x.up] if x.up >= 0 else 0
        if x.truth is not None:
            own[k] = x.truth == "1"
            continue
        top = x.tag in ("article", "main")
        apart = x.tag in ("nav", "footer", "aside", "form") or x.tag == "header" and not inside or not top and not x.tokens.isdisjoint(APART)
        lost[k] = x.up >= 0 and lost[x.up] or bool(inside) and apart
        own[k] = not lost[k] and (top or inside and not apart)
    out = own.copy()
    for k in range(len(nodes) - 1, 0, -1):
        if out[k] and (nodes[k].text or nodes[k].kids):
            out[nodes[k].up] = 1
    return out


def composed(pages: list[str], count: int, seed: int = 3) -> list[str]:
    """Pages in other layouts from the paragraphs of ``pages``; data-truth marks what is content."""
    rng = np.random.default_rng(seed)
    texts = [x.text for p in pages for x in parse(p) if x.tag == "#text" and len(x.text) > 1]
    long = [t for t in texts if len(t) > 60] or texts
    if not texts:
        return []
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    words = [w for t in texts[:2000] for w in t.split()[:20]]
    phrase = lambda low, high: html.escape(" ".join(pick(words) for _ in range(int(rng.integers(low, high)))))
    paragraph = lambda: html.escape(pick(long)[: int(rng.integers(60, 900))])
    links = lambda n: "".join(f'<li><a href="#">{phrase(1, 4)}</a></li>' for _ in range(n))

    def box(kind: str, tag: str, inside: str) -> str:
        name = pick(BAD[kind])
        attr = pick([f'class="{name}"', f'id="{name}"', f'class="{name} {pick(["box", "wide", "inner"])}"', f'class="site-{name}"', ""])
        named = pick([tag, tag, "div", "section"])
        if not attr and named in ("div", "section"):
            attr = f'class="{name}"'
        return f'<{named} {attr} data-truth="0">{inside}</{named}>'

    def rejects() -> dict[str, str]:
        return {
            "menu": box("menu", "nav", f"<ul>{links(int(rng.integers(2, 9)))}</ul>"),
            "top": box("top", "header", pick([f"<h1>{phrase(1, 4)}</h1><p>{phrase(3, 9)}</p>", f"<div>{phrase(1, 3)}</div>", f"<p>{phrase(2, 12)}</p>"])),
            "bottom": box("bottom", "footer", pick([f"&copy; {phrase(4, 20)}", f"<p>{phrase(4, 15)}</p><ul>{links(3)}</ul>"])),
            "side": box("side", "aside", pick([f"<h3>{phrase(1, 4)}</h3><ul>{links(4)}</ul>", f"<p>{paragraph()}</p>", f"<h3>{phrase(2, 4)}</h3><p>{phrase(5, 30)}</p>"])),
            "advert": box("advert", "div", pick([phrase(4, 25), f"<p>{paragraph()}</p>", f'<a href="#">{phrase(2, 8)}</a>'])),
            "notice": box("notice", "div", pick([phrase(5, 30), f"<p>{paragraph()}</p>"])),
            "form": box("form", "form", f'<label>{phrase(1, 4)}</label><input type="text"><p>{phrase(2, 12)}</p>'),
            "reader": box("reader", "section", f"<h3>{phrase(1, 3)}</h3>" + "".join(f'<div class="{pick(["comment", "item", "reply"])}"><b>{phrase(1, 2)}</b><p>{paragraph()}</p></div>' for _ in range(int(rng.integers(1, 5))))),
        }

    def content() -> str:
        parts = [f"<{pick(['h1', 'h1', 'h2'])}>{phrase(3, 10)}</h1>"]
        for _ in range(int(rng.integers(1, 12))):
            parts.append(
                pick([f"<p>{paragraph()}</p>"] * 6 + [f"<p>{phrase(1, 8)}.</p>", f"<h2>{phrase(2, 6)}</h2>", f"<ul>{''.join(f'<li>{phrase(2, 12)}</li>' for _ in range(3))}</ul>", f"<blockquote>{paragraph()}</blockquote>", f"<div>{paragraph()}</div>", f"<table><tr><td>{phrase(1, 5)}</td><td>{phrase(1, 5)}</td></tr></table>"])
            )
        if rng.random() < 0.3:
            parts.insert(int(rng.integers(1, len(parts) + 1)), rejects()[pick(["advert", "form", "side", "notice", "reader"])])
        return "".join(parts)

    out = []
    for _ in range(count):
        name = pick(sorted(GOOD))
        start, end = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), (f'<section class="post-{name}">', "</section>"), ('<div role="main">', "</div>"), ("<div>", "</div>")])
        main = start.replace(">", ' data-truth="1">') + content() + end
        r = rejects()
        for _ in range(int(rng.integers(0, 3))):
            main = f'<div class="{pick(["container", "wrapper", "row", "page", "inner", "layout"])}">{main}</div>'
        before = "".join(r[k] for k in ("notice", "top", "menu", "advert", "side") if rng.random() < 0.5)
        after = "".join(r[k] for k in ("side", "advert", "reader", "form", "menu", "notice", "bottom") if rng.random() < 0.4)
        out.append(f"<html><body>{before}{main}{after}</body></html>")
    return out


def _sampled(pages: DataFrame, sample: int) -> list[str]:
    """Up to ``sample`` distinct pages in the order of a hash, up to the page that brings them to ``SAMPLE_CHARS``.

    The table is thinned by its count of distinct pages; lengths come to the driver
    first, so that only the pages taken do.
    """
    keyed = pages.select("html", F.xxhash64("html").alias("h"))
    few = thinned(keyed, F.col("html"), sample, keyed.select("h").distinct().count())
    sizes = few.groupBy("h").agg(F.max(F.length("html")).alias("size")).orderBy("h").limit(sample).collect()
    before = np.cumsum([0, *(r["size"] for r in sizes)])
    taken = [r["h"] for r, n in zip(sizes, before, strict=False) if n < SAMPLE_CHARS]
    rows = few.where(F.col("h").isin(taken)).groupBy("h").agg(F.min("html").alias("html")).collect() if taken else []
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def learn(pages: DataFrame, sample: int = SAMPLE, count: int = COMPOSED) -> Trees:
    """Trees from up to ``sample`` pages with an article, chosen by a hash of the text, and ``count`` composed ones.

    Where no page has one, from pages composed of the texts of any pages.
    """
    every = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    rows = _sampled(every.where(F.col("html").rlike("(?i)<(article|main)\\b")), sample)
    made = composed(rows or _sampled(every, sample), count)
    parsed = [parse(p) for p in rows] + [parse(p, True) for p in made]
    if not parsed:
        return Trees(0.0, np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    x = np.concatenate([node_features(p) for p in parsed])
    y = np.concatenate([truths(p) for p in parsed])
    weight = np.concatenate([np.where([bool(n.text) for n in p], 1.0, 0.7) for p in parsed])
    return boost(x, y, weight)


def extracted(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null page is empty and gives the empty text. Without trained trees (no page
    has a text) nothing is kept. Pages of any length are read whole, in time linear in
    their length. Repeated rows come back as often as they came; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            rows = b.column(2).to_pylist()
            for at in range(0, len(rows), 200):
                parsed = [parse(p) for p in rows[at : at + 200]]
                odds = sent.value.log_odds(np.concatenate([node_features(p) for p in parsed]))
                cut = np.cumsum([len(p) for p in parsed])[:-1]
                texts += [decoded(p, o) for p, o in zip(parsed, np.split(odds, cut), strict=True)]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        of_batch, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )


def main_text(pages: DataFrame) -> DataFrame:
    """``extracted`` with trees learned from the pages themselves; see there for nulls, empty tables and long pages."""
    return extracted(pages, learn(pages))
