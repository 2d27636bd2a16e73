"""Main-text extraction from HTML pages by a minimum cut.

A page is read once into text blocks. A classifier, a fixed linear model over tags, ancestors, names
and link density, gives each block a cost for calling it content and one for calling it boilerplate.
These are the capacities from the source and to the sink; neighbours in page order and blocks that are
near in the tree are joined by edges that a different label would cut. The maximum flow from source
to sink gives the cheapest labelling as a whole: the blocks still reachable from the source are the
content. Blocks in parts that never hold the article (menus, forms, scripts and so on) have an
infinite cost as content and no edges.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SKIP = frozenset("head script style noscript template nav header footer aside form button select option textarea svg math canvas iframe object dialog menu noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind is closed by a start tag of the second, up to an element of the third.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|subscri\w*|newsletter|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|sidebar|side|widget|related|recommend\w*|share|sharing|social|toolbar|masthead|"
    r"comments?|respond|disqus|replies|reply|footer|foot|copyright|legal|skip|tags|search|header|hidden|hide|sr-only|visually-hidden|toc)(?:$|[^a-z])")
GOOD = re.compile(r"(?:^|[^a-z])(?:article|main|content|entry|post|story|body|text|prose|page)(?:$|[^a-z])")
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    link: int  # characters inside links
    path: tuple[int, ...]  # element numbers from the root
    tag: str
    never: bool
    noise: int
    good: int
    inside: bool  # below article or main


class _Node(NamedTuple):
    tag: str
    number: int
    never: bool
    noise: int
    good: int
    inside: bool


def _names(tag: str, text: str) -> tuple[bool, int, int]:
    """Whether attributes hide the element, and how often its names sound like noise or content."""
    if not text.strip(" /"):
        return False, 0, 0
    noise = good = 0
    never = False
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if name in ("class", "id", "data-role", "itemprop"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", "-")
            noise += bool(NOISE.search(value))
            good += bool(GOOD.search(value))
        elif name == "role":
            never |= value.strip().lower() in ROLE
            good += value.strip().lower() in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            never = True
    return never, noise, good


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    stack = [_Node("", 0, False, 0, 0, False)]
    out: list[Block] = []
    parts: list[str] = []
    link = links = number = 0

    def flush():
        nonlocal link
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                top = next((n for n in reversed(stack) if n.tag in BLOCK or not n.tag))
                out.append(Block(text, link, tuple(n.number for n in stack), top.tag, stack[-1].never, stack[-1].noise, stack[-1].good, stack[-1].inside))
            parts.clear()
        link = 0

    def add(text: str):
        nonlocal link
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                link += len(text.strip())

    def close(at: int):
        nonlocal links
        if any(n.tag in BLOCK for n in stack[at:]):
            flush()
        links -= sum(n.tag == "a" for n in stack[at:])
        del stack[at:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("table", "article", "body") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in IMPLIED:
            same, until = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in same:
                    close(i)
                    break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            if tag == "hr":
                flush()
            continue
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        number += 1
        never, noise, good = _names(tag, m[3])
        up = stack[-1]
        # a header inside the article holds its title; elsewhere it is the page's
        skip = tag in SKIP and not (tag == "header" and up.inside)
        wrapper = tag in ("html", "body", "article", "main")
        stack.append(_Node(tag, number, up.never or skip or never and not wrapper, up.noise + (0 if wrapper else noise), up.good + good, up.inside or tag in ("article", "main") and not up.noise))
        if tag == "a":
            links += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            stop = end.start() if end else size
            close(len(stack) - 1)
            at = end.end() if end else stop
    flush()
    return out


def _costs(b: Block, any_inside: bool) -> tuple[float, float]:
    """Cost as boilerplate (capacity from the source) and as content (capacity to the sink)."""
    size = len(b.text)
    density = min(1.0, b.link / max(1, size))
    z = 0.4 * math.log1p(size / 20) + (0.6 if b.text[-1:] in ".!?:;…。" else 0.0) - 4.0 * density - 8.0 * min(b.noise, 2) + 0.5 * min(b.good, 2)
    if b.tag in ("p", "blockquote", "pre", "figcaption") or b.tag in HEADING:
        z += 1.0
    if any_inside:
        z += 3.0 if b.inside else -3.0
    elif b.tag in ("li", "td", "div", "body", "", "section"):
        z -= 0.3
    content = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return -math.log(max(1e-9, 1 - content)), -math.log(max(1e-9, content))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by shortest augmenting paths (level graphs)."""
    n = len(source)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def join(a, b, forward, backward):
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(backward)

    for i in range(n):
        through = min(source[i], sink[i])  # flows straight through
        if source[i] > through:
            join(s, i, source[i] - through, 0.0)
        if sink[i] > through:
            join(i, t, sink[i] - through, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None, near: float = 0.6, kin: float = 0.6) -> str:
    """Content blocks of a page, one to a line."""
    found = [b for b in blocks(page or "") if not b.never]
    if not found:
        return ""
    inside = any(b.inside for b in found)
    source, sink = zip(*(_costs(b, inside) for b in found), strict=True)
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            shared = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                shared += 1
            apart = len(a.path) + len(b.path) - 2 * shared
            if a.inside == b.inside and a.noise == b.noise:
                edges.append((i - 1, i, near / (1 + apart / 4)))
        if len(b.path) > 1 and (j := last.get(b.path[-2])) is not None and found[j].noise == b.noise:
            edges.append((j, i, kin))  # siblings
        if len(b.path) > 1:
            last[b.path[-2]] = i
    keep = minimum_cut(list(source), list(sink), edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(batches):
    for batch in batches:
        text = [main_text(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_content(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text (blocks joined by a line feed, empty if there is
    none) and n_chars (its code points). White space inside a block is one space; character references
    are decoded. Null html: empty text. Null ids and urls, and repeated rows, come back as they are.
    Empty table: empty result. Extra columns are not read. Pages are independent: no shuffle.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
