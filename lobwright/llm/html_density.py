"""Main text of HTML pages by composite text density.

A tolerant scan builds the tree of the page's elements.  What is never article text (scripts, styles, forms, menus, headers,
footers, sidebars, and blocks whose class or id says notice, advert or comments) is left out.  Every other node gets its
density: characters per tag, lowered by the share of link characters, by the composite formula

    D = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

with C, T the characters and tags below the node, LC, LT those of links, and b the body.  The subtree with the largest sum
of its children's densities holds the article.  An enclosing article or main element is all article.  Without one, the subtree
grows to its parent as long as the rest of the parent is not mostly links (headings, short sections); where it is, the
neighbours that are not mostly links belong to the article too.

Text: character references decoded, white space inside a block turned into one space, blocks joined in page order.  Null and
empty pages give empty text; repeated rows get the same text each; malformed markup is read as far as it makes sense; an
empty table gives no rows; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by their role.
LEFT_OUT = frozenset("script style noscript template head title nav header footer aside select textarea iframe object svg canvas".split())
#: Left out like marked blocks: not where they are wrapped around the article.
WRAPPERS = frozenset("form button menu dialog".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol menu table td th article section div main button".split())
#: Words in a class, id or role that mark a block as no part of the article: a whole name of them, or of them and ``NEUTRAL``.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsored sponsor sponsors promo promos promotion promotions cookie cookies "
    "consent gdpr notice notices alert alerts popup popups modal modals newsletter newsletters subscribe subscription comment comments commentlist disqus respond "
    "replies sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer footers header headers masthead share sharing social related "
    "recommended widget widgets complementary contentinfo search login signup".split())
NEUTRAL = frozenset("area bar block body bottom box buttons container form icons inner left links list main page post posts primary right secondary section site slot thread top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^<>]*)>?")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)

#: A neighbour with more of its characters in links is no part of the article.
LINKS = 0.5


def attributes(tag: str) -> dict[str, str]:
    """By lower-cased name; of repeated ones the first, as browsers do."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def says(names: str, words: frozenset[str] = BOILERPLATE) -> bool:
    """True if one of the names consists of ``words``, with ``NEUTRAL`` ones or without."""
    for name in names.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split("[_-]+", name)]
        if any(p in words for p in parts) and all(not p or p in BOILERPLATE or p in NEUTRAL for p in parts):
            return True
    return False


def marked(name: str, given: dict[str, str], inside: bool) -> bool:
    """True if an element's class, id or role says that it is no part of the article; ``inside`` an article or main, ids of sections don't count."""
    if name in HEADINGS or name == "main":
        return False
    names = f"{given.get('class', '')} {given.get('role', '')}"
    if name not in INLINE and not (inside and (name == "section" or "section" in given.get("class", "").split())):
        names += f" {given.get('id', '')}"
    return says(names, COMMENTS if name == "article" else BOILERPLATE)


class Node:
    __slots__ = ("name", "parent", "out", "mark", "inside", "outer_p", "outer_item", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, out: bool):
        self.name, self.parent, self.out, self.mark = name, parent, out, False
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        # The outermost open paragraph, and paragraph or item, that a block or an item that begins here would end.
        scoped = parent is not None and name not in SCOPES
        self.outer_p = (parent.outer_p or (self if name == "p" else None)) if scoped else None
        self.outer_item = (parent.outer_item or (self if name in ("p", "li") else None)) if scoped else None
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def parse(page: str) -> Node:
    """The page's tree; text is kept as decoded strings between the nodes."""
    root = here = Node("body", None, False)
    at, strict, size, lower, any_mark = 0, True, len(page), None, False
    opened: Counter[str] = Counter()

    def rise(to: Node) -> Node:
        """Closes what is open below ``to``; each element once, so the work is in proportion to the tags."""
        up = here
        while up is not to:
            opened[up.name] -= 1
            up = up.parent
        return to

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            here.parts.append(references.unescape(page[at:start]))
        at = start
        if at >= size:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, at) if strict else None
        if tag is None and (tag := _LOOSE.match(page, at)) is not None:
            strict = strict and "\"" not in tag[3] and "'" not in tag[3]  # an open quotation: don't look for its end again
        if tag is None:  # a sign, not a tag
            here.parts.append("<")
            at += 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if opened[name] > 0:
                up = here
                while up.name != name:
                    up = up.parent
                here = rise(up.parent)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P or name == "li":  # a paragraph ends where a block begins; an item where the next begins
            closed = here.outer_p if name in CLOSES_P else here.outer_item
            if closed is not None:
                here = rise(closed.parent)
        given = attributes(tag[3]) if tag[3] else {}
        hidden = bool(given) and ("hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(given.get("style", ""))))
        node = Node(name, here, here.out or name in LEFT_OUT or hidden)
        node.mark = name in WRAPPERS or (bool(given) and marked(name, given, node.inside))
        any_mark = any_mark or node.mark
        here.parts.append(node)
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == size else page.find(f"</{name}", at)
            at = size if end < 0 else end
            if end < 0:
                break
            close = page.find(">", at)
            at = size if close < 0 else close + 1
        elif name not in VOID and (not tag[3].endswith("/") or name in ("p", "div", "li", "article", "section", "span", "a", "b")):
            here = node
            opened[name] += 1
    if any_mark:
        strike(root)
    return root


def strike(root: Node) -> None:
    """Leaves marked elements out, but none around the largest article or main, or, on a page without, around most of the text outside links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node) and not p.out]
    plain: dict[Node, int] = {}
    for node in reversed(order):
        plain[node] = 0 if node.name == "a" else sum(plain[p] if isinstance(p, Node) else len("".join(p.split())) for p in node.parts if isinstance(p, str) or not p.out)
    keep: set[Node] = set()
    up = max((n for n in order if n.name in ("article", "main") and not n.mark), key=plain.__getitem__, default=None)
    bare = up is None
    while up is not None:
        keep.add(up)
        up = up.parent
    for node in order:
        if node.mark and node not in keep and not (bare and 2 * plain[node] > plain[root]):
            node.out = True


def measure(root: Node) -> list[Node]:
    """Fills in counts and densities; the nodes that can be part of an article, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.out]
    for node in reversed(order):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars += own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1e-9) if base > 1.0 + 1e-9 else c / t * math.log(max(c * t, 1.0))
            node.density = max(node.density, 0.0)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def article_nodes(root: Node) -> list[Node | str]:
    """The subtrees and texts that hold the article, in page order."""
    order = measure(root)
    filled = [n for n in order if n.chars]
    if not filled:
        return []
    best = max(filled, key=lambda n: (n.total, n.density))
    while best.name in INLINE or best.name == "p":
        if best.parent is None:
            break
        best = best.parent
    up = best
    while up is not None:
        if up.name in ("article", "main"):
            return [up]
        up = up.parent
    inner = [n for n in order if n.name == "article" and n.chars >= 0.5 * best.chars and best is not n]
    if inner and best is root:
        return inner
    while best.parent is not None:
        up = best.parent
        if up.link_chars - best.link_chars > LINKS * (up.chars - best.chars):
            return [p for p in up.parts if isinstance(p, str) or not p.out and p.chars and (p is best or p.name in HEADINGS or p.link_chars <= LINKS * p.chars)]
        best = up
    return [best]


def node_text(nodes: list[Node | str]) -> str:
    """Blocks in page order, each with single spaces, joined by a space."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.name == "br":
            run.append(" ")
        elif not part.out:
            if part.name not in INLINE:
                close()
                todo.append(None)
            todo += reversed(part.parts)
    close()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    return node_text(article_nodes(parse(page))) if page else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).  No shuffle; pages are read one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
