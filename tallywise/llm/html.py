"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tallywise.llm.batches import with_computed

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)",  # quotes count after = only
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")

# Fixed values of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_AROUND_P = _BLOCK - _HEADINGS - {"p"}
#: A start tag of the key ends open elements of the value, up to an element of _SCOPE.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}

# What is no part of an article.
_DROPPED = _RAW | set("nav footer aside button select input menu head svg canvas object audio video map annotation annotation-xml".split())
_WRAPPERS = {"form", "fieldset", "dialog"}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HINTS = set(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login paywall sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar "
    "masthead topbar header footer foot copyright share sharing social related recommended recommendations trending widget widgets "
    "comment comments commentlist reply replies respond disqus discussion reactions".split()
)
_COMMENTS = set("comment comments commentlist disqus".split())
_COMMENT_PARTS = set(
    "list area section thread wrap wrapper container box body form content item text block reader readers user users post".split()
)
_ROOTS = {"html", "body", "main", "article"}
_ARTICLES = {"article", "main"}


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    in_article: bool = False
    in_form: bool = False
    articles: int = 0
    size: int = 0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


class _Open:
    """The open elements, with the places of each tag among them: no look-up walks over open elements."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def last(self, tags: set[str]) -> int:
        """The innermost place of one of ``tags``; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def end(self, place: int) -> None:
        """End the element at ``place`` and all in it."""
        while len(self.nodes) > place > 0:
            self.places[self.nodes.pop().tag].pop()

    def end_implied(self, tag: str) -> None:
        if tag in _BLOCK and tag != "br":  # a block ends an open paragraph, and what is open in it
            paragraph = self.last({"p"})
            if paragraph and paragraph > self.last(_AROUND_P):
                self.end(paragraph)
        ends = _ENDS.get(tag)
        if ends:
            scope = self.last(_SCOPE.get(tag, {"table"}))
            while (place := self.last(ends)) > scope:
                self.end(place)
                if tag not in ("tbody", "tfoot", "tr"):
                    break


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order. Open elements end where their parent does; stray end tags count for nothing.

    Time is linear in the page, whatever it holds.
    """
    root = Node("#root", None)
    at, open_, position, nodes = root, _Open(root), 0, [root]
    length = len(html)
    while position < length:
        start = html.find("<", position)
        part = _PART.match(html, start) if start >= 0 else None
        while start >= 0 and part is None:  # a sign that opens no tag is text
            start = html.find("<", start + 1)
            part = _PART.match(html, start) if start >= 0 else None
        end = start if start >= 0 else length
        if end > position:
            at.children.append(html[position:end])
        if part is None:
            break
        position = part.end()
        name = part[2]
        if name is None or not part[4]:  # a comment, or a tag that the page's end cuts off
            continue
        tag = name.lower()
        if part[1]:
            open_.end(open_.last({tag}))
            at = open_.nodes[-1]
            continue
        open_.end_implied(tag)
        at = open_.nodes[-1]
        node = Node(tag, at, _attributes(part[3]))
        node.in_article = at.in_article or at.tag in _ARTICLES
        node.in_form = at.in_form or at.tag == "form"
        at.children.append(node)
        nodes.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, position)
            position = close.end() if close else length
        elif tag not in _VOID and not part[3].endswith("/"):
            open_.push(node)
            at = node
    return root, nodes


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _weigh(nodes: list[Node]) -> None:
    """Articles and characters that stand in each element, those of comments and of dropped elements left out."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            elif c.tag not in _DROPPED and not _is_comment(c):
                node.size += c.size
                node.articles += c.articles + (c.tag in _ARTICLES)


def _is_noise(node: Node, page: Node) -> bool:
    tag, attributes = node.tag, node.attributes
    if tag in _DROPPED or _is_comment(node):
        return True
    if tag == "header":
        return not node.in_article
    if tag == "label":
        return node.in_form and not node.in_article
    if tag in _WRAPPERS:
        return not _wraps(node, page)
    if not attributes or tag in _ROOTS:
        return False
    if (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I)
        or attributes.get("role", "").lower() in _ROLES
    ):
        return not _wraps(node, page)
    return _is_named(f"{attributes.get('class', '')} {_own_id(node)}") and not node.in_article and not node.articles


def _wraps(node: Node, page: Node) -> bool:
    """Whether an element is put around the article: all article and main elements of the page stand in it or, where the
    page has none, over half of the text.
    """
    return node.articles == page.articles if page.articles else 2 * node.size > page.size


def _is_comment(node: Node) -> bool:
    """Readers' comments, by a class name or id such as ``comments`` or ``comment-list``."""
    if not node.attributes or node.tag in ("html", "body", "main") or node.tag in _HEADINGS:
        return False
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        parts = set(_words(name))
        if parts & _COMMENTS and parts <= _HINTS | _COMMENT_PARTS:
            return True
    return False


def _words(name: str) -> list[str]:
    return _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _own_id(node: Node) -> str:
    return "" if node.tag in _HEADINGS else node.attributes.get("id", "")  # a heading's is made from its words


def _is_named(names: str) -> bool:
    """Whether one of the names consists of hints alone; ``has-sidebar`` doesn't."""
    for name in names.split():
        parts = _words(name)
        if parts and _HINTS.issuperset(parts):
            return True
    return False


def prune(root: Node, nodes: list[Node]) -> None:
    """Take away elements that are never part of an article.

    Forms, dialogs, hidden elements and roles go unless they are put around the article (``_wraps``).
    """
    _weigh(nodes)
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _is_noise(c, root)]
        stack += [c for c in node.children if not isinstance(c, str)]


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, tags and both within links, then the composite density of every element below ``body``.

    Density is characters per tag, scaled down where the text stands in links: the logarithm of C/LC * T/LT to a base that
    grows with the share of link text (C, T: characters and tags; LC, LT: those in links).
    """
    for node in reversed(nodes):
        inside = node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                node.chars += sum(map(len, unescape(c).split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if inside:
            node.link_chars, node.link_tags = node.chars, node.tags
    whole = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not c:
            continue
        base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
        scaled = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(max(base, math.e))
        node.density = c / t * scaled
    for node in nodes:
        if node.parent is not None:
            node.parent.density_sum += node.density


def _path(nodes: list[Node], body: Node) -> tuple[Node, float]:
    best = max(nodes, key=lambda n: n.density)
    threshold, at = best.density, best
    while at is not body and at.parent is not None:
        at = at.parent
        threshold = min(threshold, at.density)
    return best, threshold


def select(nodes: list[Node], body: Node) -> Node:
    """The element with the largest sum of its children's densities, of those at least as dense as the path allows.

    The threshold is the least density on the way from the densest element up to ``body``. The article or main element
    around the choice, if there is one, is taken whole; else the choice widens to its parent as long as that adds a quarter of
    unlinked text or more at the threshold's density.
    """
    best, threshold = _path(nodes, body)
    chosen = max((n for n in nodes if n.density >= threshold), key=lambda n: n.density_sum)
    if not chosen.density_sum:
        chosen = best
    at, around = chosen, None
    while at is not None:
        if at.tag in ("article", "main") and (around is None or at.tag == "article"):
            around = at
        at = at.parent
    if around:
        return around
    while chosen is not body and chosen.parent is not None:  # a part of an article in several parts
        above = chosen.parent
        if above.chars - above.link_chars < 1.25 * (chosen.chars - chosen.link_chars) or above.density < threshold:
            break
        chosen = above
    return chosen


def _linked(node: Node) -> bool:
    """A block of links."""
    return node.tag in _BLOCK and node.link_tags > 1 and node.link_chars > 0.6 * node.chars


def blocks_of(node: Node, threshold: float = 0.0) -> list[str]:
    """Texts of the blocks in page order, with single spaces.

    Within an article, elements whose class names say they are no part of it go if they are less dense than ``threshold``.
    Blocks of links go only where no part of the page was chosen.
    """
    whole = node.tag in ("body", "html", "#root")
    blocks, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        item, over = stack.pop()
        if isinstance(item, str):
            run.append(unescape(item))
            continue
        if item.tag in _BLOCK:
            flush()
        if over or (item is not node and whole and _linked(item)):
            continue
        if item is not node and item.density < threshold and item.tag not in _HEADINGS | _ROOTS:
            if _is_named(item.attributes.get("class", "")):
                continue
        stack.append((item, True))
        stack += [(c, False) for c in reversed(item.children)]
    flush()
    return blocks


def main_text(html: str) -> str:
    """Main text of one page: blocks in page order, joined by one space; empty if there is none."""
    root, nodes = parse(html)
    prune(root, nodes)
    kept = []
    stack = [root]
    while stack:  # page order, without what was pruned
        node = stack.pop()
        kept.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    body = next((n for n in kept if n.tag == "body"), root)
    measure(kept, body)
    inside = [n for n in kept if n.chars and (n is body or n.tag not in ("#root", "html"))] or [body]
    chosen = select(inside, body)
    blocks = blocks_of(chosen, _path(inside, body)[1])
    if chosen.tag not in _ROOTS:  # a title that stands before the chosen part
        titles, seen = [], set()
        for n in kept:
            if n is chosen:
                break
            if n.parent is not None and id(n.parent) in seen:  # within a title
                seen.add(id(n))
            elif n.tag == "h1" and n.chars:
                seen.add(id(n))
                titles = blocks_of(n) + titles
        blocks = titles + blocks
    return " ".join(blocks)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole ``html_col`` (null counts as empty, and gives an empty text).

    Every row is extracted by itself, equal rows alike; extra columns pass, one named ``text`` is replaced. No shuffle.
    """

    def start():
        return lambda b: [pa.array([main_text(h.as_py() or "") for h in b.column(html_col)], pa.string())]

    return with_computed(pages, "text string", start)
