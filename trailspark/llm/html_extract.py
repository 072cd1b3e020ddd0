"""Main text of web pages by composite text density.

The page becomes a tree. Every node gets its characters per tag, adjusted by how much of its text and how
many of its tags belong to links; a node's density sum is that of its children that are blocks (text in bold is its paragraph's). The node with the largest
sum holds the article, and the least density on its path to the body is the threshold that its ancestors'
other children and their stretches of bare text must reach to belong to the article too. Parts that say what they are (menus, forms, adverts,
notices, comments and the like) leave the tree first, unless they hold most of the page's text outside links.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}
#: Which open elements a start tag ends, and where the search for them stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"})}
#: Elements, roles and names (of classes and ids) that say their content is not the article.
DROP_TAGS = frozenset("nav aside form button select label dialog menu fieldset head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar aside widget widgets nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond discussion toolbar skip".split())
#: Words that turn the next one of a name into its opposite, and names that an article's sections have too: those are
#: believed of parts that are mostly links or hold other such parts.
NOT_NAMES = frozenset("no not non without with has hide".split())
UNSURE_NAMES = frozenset("related recommended discussion social notice notices alert promotion subscription".split())
#: Names of parts that may hold more text than the article, and elements that never hold it.
LONG_NAMES = frozenset("comment comments commentlist disqus reply replies respond cookie cookies consent gdpr".split())
NEVER_TAGS = frozenset("nav button select dialog menu".split())
#: Names and elements that mean the frame of the page, unless they stand inside an article.
FRAME_NAMES, FRAME_TAGS = frozenset("header footer masthead topbar bottombar foot copyright".split()), frozenset({"header", "footer"})
KEEP = frozenset("html body main article".split())

_NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Where a tag ends, or a quoted value begins, in which no sign ends a tag.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([a-zA-Z_:@][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING = re.compile(r"h[1-6]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "holds", "inside", "block")

    def __init__(self, tag: str, attrs: dict[str, str], parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.own, self.inside = _KINDS.get(tag, 0), parent is not None and (parent.inside or parent.tag in ("article", "main"))


#: What a node is, or holds, that decides about the parts around it.
ARTICLE, TITLE, HEADING, PARAGRAPH, SURE = 1, 2, 4, 8, 16
_KINDS = {"article": ARTICLE, "main": ARTICLE, "h1": TITLE | HEADING, "h2": HEADING, "h3": HEADING, "p": PARAGRAPH}


class Tokens:
    """Reads a page once from left to right: what was not found behind a place is never looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, sign: str, at: int) -> int:
        k = -1 if sign in self.gone else self.page.find(sign, at)
        if k < 0:
            self.gone.add(sign)
        return k

    def end_of_tag(self, at: int) -> int:
        """Where the ``>`` of a tag stands, quoted values passed over; a quote without an end is a sign like any other."""
        while m := _STOP.search(self.page, at):
            if not m[1]:
                return m.start()
            close = self.find(m[1], m.end())
            at = close + 1 if close >= 0 else m.end()
        return -1

    def end_of_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of an element without markup, -1 without one."""
        if f"</{tag}" in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if not m:
            self.gone.add(f"</{tag}")
        return m.end() if m else -1

    def __iter__(self):
        """Texts, and (closing, tag, attributes, place behind it) of tags. ``self.at`` may be moved on by the reader."""
        page, self.at = self.page, 0
        while self.at < len(page):
            start = self.find("<", self.at)
            if start < 0 or ">" in self.gone:
                yield page[self.at :]
                return
            if start > self.at:
                yield page[self.at : start]
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else len(page)
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                end = self.find(">", start)
                self.at = end + 1 if end >= 0 else len(page)
                continue
            m = _NAME_OF_TAG.match(page, start + 1)
            end = self.end_of_tag(m.end()) if m else -1
            if end < 0:
                if m:
                    self.find(">", m.end())
                self.at = start + 1
                yield "<"
                continue
            self.at = end + 1
            yield m[1] == "/", m[2].lower(), page[m.end() : end]


def parse(page: str) -> Node:
    """A tolerant tree: unclosed and stray tags, raw-text elements and missing ends are all accepted."""
    root = cur = Node("html", {}, None)
    tokens, opened = Tokens(page), Counter()
    for token in tokens:
        if isinstance(token, str):
            cur.items.append(token)
            continue
        closing, tag, rest = token
        if closing:
            if opened[tag]:
                while cur.tag != tag:
                    opened[cur.tag] -= 1
                    cur = cur.parent
                opened[tag] -= 1
                cur = cur.parent
            continue
        upto = None
        if tag in CLOSES_P and opened["p"]:
            n = cur
            while n.parent is not None and n.tag not in ("p", "button", "table", "td", "th", "div", "article", "section"):
                n = n.parent
            upto = n if n.tag == "p" else None
        if upto is None and tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag][0]):
            ends, stop = SIBLINGS[tag]
            n = cur
            while n.parent is not None and n.tag not in stop:
                upto = n if n.tag in ends else upto
                n = n.parent
        if upto is None and tag == "body" and cur.tag == "head":
            upto = cur
        if upto is not None:
            after = upto.parent
            while cur is not after:
                opened[cur.tag] -= 1
                cur = cur.parent
        if tag == "html":
            continue
        attrs = {a[1].lower(): unescape(a[2].strip("\"'")) if a[2] else "" for a in _ATTR.finditer(rest)} if rest.strip(" /") else {}
        node = Node(tag, attrs, cur)
        cur.items.append(node)
        if tag in RAW:
            end = tokens.end_of_raw(tag, tokens.at)
            tokens.at = end if end >= 0 else len(page) if tag in ("script", "style") else tokens.at
        elif tag not in VOID and not rest.endswith("/"):
            cur = node
            opened[tag] += 1
    return root


def _names(node: Node) -> set[str]:
    if not ("class" in node.attrs or "id" in node.attrs):
        return set()
    words = [x.lower() for x in _NAME.findall(f"{node.attrs.get('class', '')} ; {node.attrs.get('id', '')}")]
    return {x for before, x in zip(["", *words], words) if before not in NOT_NAMES}


def _declared(node: Node, root: Node, titled: bool, marked: bool, strict: bool) -> bool:
    """Whether the element says that it is no part of the article, and does not hold most of the page's text outside
    links (which it may where an article is ``marked`` elsewhere); with ``strict`` off only what never holds an article counts."""
    if node.tag in RAW or node.tag == "head":
        return True
    if node.tag in KEEP:
        return False
    a, whole = node.attrs, node.own | node.holds
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    holds_article = bool(whole & (ARTICLE | TITLE))
    if node.tag in NEVER_TAGS:
        return not holds_article
    names = _names(node)
    most = 2 * (node.chars - node.link_chars) > root.chars - root.link_chars
    if not strict or most and (not marked or node.inside) and not (titled and (node.tag in FRAME_TAGS or names & (LONG_NAMES | FRAME_NAMES))):
        return False
    if node.tag in DROP_TAGS and node.tag != "label":
        return not holds_article
    # Names that an article's section may have too are believed of parts that are mostly links or hold surely named ones.
    sure = names & (DROP_NAMES - UNSURE_NAMES) or 2 * node.link_chars >= node.chars or node.holds & SURE
    if a.get("role", "").lower() in DROP_ROLES or names & DROP_NAMES and sure:
        return not holds_article
    if (node.tag in FRAME_TAGS or names & FRAME_NAMES) and not (node.inside and node.tag != "footer" and node.holds & HEADING):
        # A page's head may hold its title, but no article and no paragraph.
        return not holds_article or not whole & (ARTICLE | PARAGRAPH)
    return False


def _prune(root: Node, strict: bool = True) -> None:
    whole, stack = root.own | root.holds, [root]
    titled, marked = bool(whole & (ARTICLE | TITLE)), bool(whole & ARTICLE)
    while stack:
        n = stack.pop()
        n.items = [x for x in n.items if not (isinstance(x, Node) and _declared(x, root, titled, marked, strict))]
        stack += [x for x in n.items if isinstance(x, Node)]


def _density(c: int, t: int, lc: int, lt: int, page_c: int, page_l: int) -> float:
    """Composite density of so many characters, tags, characters in links and links, on a page of so many."""
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + page_l / page_c * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0000001)) / math.log(max(base, 1.0001)) if base > 1 else c / t * math.log(max(c * t, 2))


def _measure(root: Node) -> list[Node]:
    """Characters, tags and link shares bottom-up, then densities. Returns all nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [x for x in reversed(n.items) if isinstance(x, Node)]
    for n in reversed(order):
        kids = [x for x in n.items if isinstance(x, Node)]
        n.holds = 0
        for k in kids:
            n.holds |= k.own | k.holds | (SURE if _names(k) & (DROP_NAMES - UNSURE_NAMES) else 0)
        n.chars = sum(len("".join(x.split())) for x in n.items if isinstance(x, str)) + sum(k.chars for k in kids)
        n.tags = sum(k.tags + 1 for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.block = n.tag in BLOCK or any(k.block for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
    page_c, page_l = max(root.chars, 1), root.link_chars
    for n in order:
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, page_c, page_l)
    for n in order:
        n.total = sum(x.density for x in n.items if isinstance(x, Node) and x.block)
    return order


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Text pieces by block, in page order, without recursion."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        else:
            if x.tag in BLOCK:
                out.append([])
                stack.append(None)
            elif x.tag in ("br", "td", "th", "wbr"):
                out[-1].append(" " if x.tag != "wbr" else "")
            stack.extend(reversed(x.items))


def _kept(below: Node, above: Node, threshold: float, page_c: int, page_l: int) -> list:
    """What stays of an ancestor: the child on the path, other children and stretches of bare text and inline
    elements that reach the threshold, and headings."""
    out, run = [], []

    def close():
        nodes = [x for x in run if isinstance(x, Node)]
        c = sum(len("".join(x.split())) for x in run if isinstance(x, str)) + sum(x.chars for x in nodes)
        counts = [sum(x.tags + 1 for x in nodes), sum(x.link_chars for x in nodes), sum(x.link_tags + (x.tag == "a") for x in nodes)]
        whole = _density(c, *counts, page_c, page_l) >= threshold
        out.extend(run if whole else [x for x in nodes if x.chars and x.density >= threshold])
        run.clear()

    for x in above.items:
        if isinstance(x, str) or x is not below and x.tag not in BLOCK:
            run.append(x)
            continue
        close()
        if x is below or x.chars and (x.density >= threshold or _HEADING.fullmatch(x.tag)):
            out.append(x)
    close()
    return out


def densest(order: list[Node], root: Node) -> Node:
    """The node of the largest density sum, the first of several; the whole page where no node holds blocks of text."""
    best = max(order, key=lambda n: n.total)
    return best if best.total else root


def extract(page: str | None) -> str:
    """The article's blocks, joined by one newline; empty for null, empty and text-less pages."""
    if not page:
        return ""
    for strict in (True, False):
        root = parse(page)
        _measure(root)
        _prune(root, strict)
        order = _measure(root)
        if root.chars:
            break
    if not root.chars:
        return ""
    path = [densest(order, root)]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path if n.chars)
    for below, above in zip(path, path[1:]):
        above.items = _kept(below, above, threshold, max(root.chars, 1), root.link_chars)
    pieces: list[list[str]] = [[]]
    _blocks(root, pieces)
    texts = (" ".join(unescape("".join(p)).split()) for p in pieces)
    return "\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the ``carry`` columns, text and n_chars (code points).

    Null html is empty and gives the empty text, as does a page without an article. Repeated rows and null ids
    keep rows of their own; an empty table gives none; other columns are ignored, whatever their names.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    names = ["id", *(f"c{i}" for i in range(len(carry)))]

    def run(batches):
        for big in batches:
            for batch in text_slices(big):
                texts = [extract(h) for h in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n"])

    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names) + ", text string, n long"
    return src.mapInArrow(run, schema).select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "text", F.col("n").alias("n_chars"))
