"""Main text of HTML pages by composite text density.

For every node of the page: characters per tag, adjusted by the share of characters and tags that are links. The node
whose children's densities add up to most is the core of the page, and the least density on its path from the body is the
threshold: other subtrees whose density reaches it belong to the text too.

Names of tags and classes choose nothing, they only take away: menus, adverts and the like inside what was chosen, and
what lies outside the article or main element that holds the core. A core inside such named matter, as a long thread of
comments may be, is given up for the densest node of the rest, unless nothing there comes near the threshold; then the
name is that of a wrapper around the page's text.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: A name that says what a wrapper has or lacks tells nothing about its own text.
WRAPPER = re.compile(r"(?:has|no|with)[_-]", re.I)
# Elements without page text, names that mark other matter, and how HTML nests.
UNSEEN = set("head script style noscript template iframe svg canvas object video audio".split())
SKIPPED = set("nav header footer aside form button select option textarea dialog menu".split())
RAW = set("script style textarea title noscript iframe template svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?\w*|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|related|recommend\w*|share|sharing|social|nav\w*|menu|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|respond|reply|replies|pagination|pager|toolbar|widget|login|signup)(?:$|[\s_-])", re.I)
BLOCK = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | set("nav header footer aside form menu dialog".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"ul", "ol", "table", "dl", "select", "body", "html", "article", "main", "section", "div"}
#: Part of the threshold that the rest must reach for a core in named matter to be given up.
NEAR_PART = 0.1
#: The logarithm of the density's base goes to nothing for short texts without links, and is held here.
LEAST_LOG = 0.5


def _marks(attrs: str) -> tuple[bool, bool]:
    """Whether the attributes hide the element, and whether their names mark other matter."""
    known = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        known.setdefault(name.lower(), a or b or c)
    hints = " ".join(known.get(k, "") for k in ("class", "id", "role", "aria-label")).split()
    return "hidden" in known or bool(NO_DISPLAY.search(known.get("style", ""))), any(OTHER.search(h) and not WRAPPER.match(h) for h in hints)


def _parse(html: str):
    """Parents, tags, own unseen and named flags of the nodes, and the runs (node, text or None for a block's edge) in order."""
    parent, tag, unseen, named, runs, stack, at = [-1], ["#root"], [False], [False], [], [0], 0
    n = len(html)

    def text(piece: str) -> None:
        if piece:
            runs.append((stack[-1], piece))

    def leave(depth: int) -> None:
        for node in stack[depth:]:
            if tag[node] in BLOCK:
                runs.append((node, None))
        del stack[depth:]

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name, attrs = m.group(2).lower(), m.group(3) or ""
        if m.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] == name:
                    leave(depth)
                    break
                if name not in BLOCK and tag[stack[depth]] in BLOCK and name not in SKIPPED | UNSEEN:
                    break
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if tag[stack[depth]] == "p":
                    leave(depth)
                    break
                if tag[stack[depth]] in FENCE:
                    break
        for depth in range(len(stack) - 1, 0, -1):
            if tag[stack[depth]] in CLOSES.get(name, ()):
                leave(depth)
                break
            if tag[stack[depth]] in FENCE:
                break
        node = len(parent)
        hidden, other = _marks(attrs) if attrs and name not in ("html", "body", "article", "main") else (False, False)
        parent.append(stack[-1])
        tag.append(name)
        unseen.append(name in UNSEEN or hidden)
        named.append(other or name in SKIPPED)
        if name in VOID:
            runs.append((node, " " if name == "br" else None) if name in ("br", "hr") else (node, ""))
            continue
        if name in BLOCK:
            runs.append((node, None))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if not attrs.rstrip().endswith("/") or name in BLOCK:
            stack.append(node)
    return parent, tag, unseen, named, runs


def _density(c: float, t: float, lc: float, lt: float, body: float) -> float:
    """c characters and t tags, lc and lt of them links; body is the share of links in the whole page's characters."""
    if not c:
        return 0.0
    base = math.log(max(1.0, c / max(1.0, c - lc) * lc + body * c + math.e))
    return c / t * max(0.0, math.log(max(1.0, c / max(1.0, lc) * t / max(1.0, lt)))) / max(LEAST_LOG, math.log(max(1.0, base)))


def measures(parent: list, tag: list, gone: list, runs: list):
    """Characters, density and sum of the children's densities of each node, without the nodes that are gone."""
    n = len(parent)
    chars, links, tags, link_tags = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tag[i] == "a"
        if not gone[i]:
            tags[i] += 1
            link_tags[i] += tag[i] == "a"
    for node, piece in runs:
        if piece and not gone[node]:
            size = len(piece.strip())
            chars[node] += size
            links[node] += size if linked[node] else 0
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        link_tags[p] += link_tags[i]
    body = links[0] / chars[0] if chars[0] else 0.0
    density = [_density(chars[i], tags[i] or 1, links[i], link_tags[i], body) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        if not gone[i]:
            total[parent[i]] += density[i]
    return chars, density, total


def core_of(parent: list, tag: list, gone: list, density: list, total: list) -> tuple[int, float]:
    """The node of the greatest sum, the inner of equals, and the least density on its path from the body.

    A paragraph with marked-up text is no container: the element around it that holds blocks stands for it.
    """
    core = max(range(len(parent)), key=lambda i: (-1 if gone[i] else total[i], i))
    core = core if total[core] else 0  # text without elements around it
    holds = {parent[i] for i in range(1, len(parent)) if tag[i] in BLOCK}
    while core and core not in holds:
        core = parent[core]
    least, i = density[core], core
    while i and tag[i] != "body":
        i = parent[i]
        least = min(least, density[i])
    return core, least


def _inherited(parent: list, own: list) -> list:
    out = list(own)
    for i in range(1, len(parent)):
        out[i] = out[i] or out[parent[i]]
    return out


def _path(parent: list, node: int) -> list[int]:
    """The node and those around it, but for the root."""
    out = []
    while node > 0:
        out.append(node)
        node = parent[node]
    return out


def main_text(html: str | None) -> str:
    """The text of the page's main subtrees: their blocks, white space made single, joined by an empty line."""
    if not html:
        return ""
    parent, tag, unseen, named, runs = _parse(html)
    n = len(parent)
    unseen = _inherited(parent, unseen)
    chars, density, total = measures(parent, tag, unseen, runs)
    # a class of a wrapper around the largest article names its layout
    most = max((i for i in range(n) if tag[i] in ("article", "main") and not unseen[i]), key=lambda i: (chars[i], i), default=0)
    for i in _path(parent, most):
        named[i] = named[i] and tag[i] in SKIPPED
    core, least = core_of(parent, tag, unseen, density, total)
    other = [i for i in _path(parent, core) if named[i]]
    gone = _inherited(parent, [a or b for a, b in zip(unseen, named, strict=True)])
    if other and max((density[i] for i in range(1, n) if not gone[i] and tag[i] not in ("html", "body")), default=0) >= NEAR_PART * least:
        _, density, total = measures(parent, tag, gone, runs)
        core, least = core_of(parent, tag, gone, density, total)
    elif other:
        for i in other:
            named[i] = False
        gone = _inherited(parent, [a or b for a, b in zip(unseen, named, strict=True)])
    path = _path(parent, core)
    above = set(path)
    chosen = [not core] + [i == core or density[i] >= least and i not in above for i in range(1, n)]
    chosen = _inherited(parent, chosen)
    whole = next((i for i in path if tag[i] in ("article", "main")), 0)
    if whole:
        inside = _inherited(parent, [i == whole for i in range(n)])
        chosen = [a and b for a, b in zip(chosen, inside, strict=True)]
    blocks, now = [], []
    for node, piece in runs:
        if piece is None:
            blocks.append("".join(now))
            now = []
        elif chosen[node] and not gone[node]:
            now.append(piece)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(unescape(b).split()) for b in blocks) if b)


@F.pandas_udf(StringType())
def _main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars, one row per row.

    A null or empty page, or one without main text, has the text ''. Repeated rows give repeated results, of nodes with
    equal sums the inner one is the core, and other columns, whatever their names, are left out. A page of any length is
    parsed whole, by itself, in time and memory proportional to it; an empty table gives no rows.
    """
    return pages.select("page_id", "url", _main_text(F.coalesce("html", F.lit(""))).alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
