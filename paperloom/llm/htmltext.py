"""Main text of HTML pages by composite text density.

Every element gets a composite text density: its characters per tag, times the logarithm, to a base
that grows with the share of link text, of its unlinked share of characters and tags. An element's density sum
adds its children's. The element of the largest sum under body is the core, taken whole; the least density on
its path to body is the threshold, and what lies beside that path belongs to the text too if it reaches it
and holds more plain than linked text.

What elements say of themselves is a prior for that, not a substitute. Elements that name themselves menus, adverts,
comments and the like are cut before densities are taken, unless they hold a page's main part. A name that is also a topic
(`legal`, `social`) cuts only what else speaks against: links, controls, or that it holds no prose. If the core lies in
an article or main element, short pieces of that element belong to it too, and what isn't an article must be as dense as
it is to be taken from beside it. Elsewhere a heading right before the core begins the article: what stands between them belongs to it,
and so do paragraphs and lists that follow.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Never article text.
DROPPED = frozenset("script style noscript template svg math canvas object iframe head title nav header footer aside form button select option textarea input dialog menu audio video map noembed noframes xmp".split())
MAIN = frozenset(("article", "main"))
#: What a start tag closes, up to the next element that bounds it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody")}
BOUNDS = frozenset("ul ol dl table html body article section div main td th nav aside header footer form".split())
#: Words of class names and ids that name readers' comments, what else isn't the article, and what may be either.
_COMMENTS = frozenset("comment comments comentario comentarios commentaire commentaires kommentar kommentare disqus".split())
_AROUND = frozenset("ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs cookie cookies consent gdpr masthead menu nav navbar navigation newsletter popup modal promo sidebar sponsored subscribe signup toolbar pagination pager widget".split())
_TOPICS = frozenset("alert banner copyright disclaimer discussion footer header legal login notice notices promotion recommended related reply replies search share sharing social sponsor tags".split())
#: Words that may stand with them in a name: `comment-list` is around, `share-price` isn't.
_WITH = frozenset("site page main top bottom left right box boxes list area block section wrap wrapper container item items inner outer bar link links post entry article content body text title form count meta panel module row col column group holder region widget".split())
_ROLES = frozenset("banner navigation complementary contentinfo search dialog alertdialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: What an element says of itself.
_PLAIN, _TOPIC, _BESIDE, _COMMENT, _HIDDEN = range(5)
#: What an element must hold to stay in spite of it: 1 an article, 2 a page's main part.
_STAYS = {_TOPIC: 1, _BESIDE: 1, _COMMENT: 2}
_CONTROLS = frozenset("form input button select textarea".split())
#: What goes on with an article after its core.
_TEXTUAL = _HEADINGS | frozenset("p ul ol dl blockquote pre table figure hr".split())


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    says: int = _PLAIN
    children: list[Node | str] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def _named(name: str, alone: bool) -> int:
    """What a class name or id says; with `alone`, only if it is one word."""
    found = _PLAIN
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    if alone and len(parts) > 1:
        return _PLAIN
    for x in parts:
        if x in _COMMENTS:
            found = _COMMENT
        elif x in _AROUND:
            found = max(found, _BESIDE)
        elif x in _TOPICS:
            found = max(found, _TOPIC)
        elif x not in _WITH:
            return _PLAIN
    return found


def _says(tag: str, attributes: str) -> int:
    found = _PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return _HIDDEN
        if name == "role" and value in _ROLES:
            found = max(found, _BESIDE)
        elif tag in INLINE or tag in _HEADINGS or (tag == "p" and name == "id"):
            continue  # names of words and places in the text
        elif name in ("class", "id"):
            found = max([found, *(_named(x, tag == "p") for x in value.split())])
    return found


def parse(text: str) -> Node:
    """A tree from HTML that need not be well formed."""
    root = Node("html", None)
    stack = [root]
    at = 0
    while m := _TOKEN.search(text, at):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            _end(stack, tag)
            continue
        if tag == "html":
            continue
        _imply(stack, tag)
        node = Node(tag, stack[-1], _says(tag, m[3]) if len(m[3]) > 4 else _PLAIN)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag not in VOID and not m[3].endswith("/>"):
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _imply(stack: list[Node], tag: str) -> None:
    """End tags that a start tag implies: a block ends an open paragraph, an item the item before."""
    closes = CLOSES.get(tag, ())
    if tag not in INLINE and tag not in RAW:
        closes = (*closes, "p")
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in closes:
            del stack[i:]
            return _imply(stack, tag)
        if stack[i].tag in BOUNDS and not (tag in CLOSES and stack[i].tag in CLOSES[tag]):
            return None
    return None


def _end(stack: list[Node], tag: str) -> None:
    inline = tag in INLINE or tag == "p"
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if inline and stack[i].tag in BOUNDS:  # a stray end tag
            return


def _under(root: Node) -> list[Node]:
    """The elements from `root` on, parents first."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    return order


def _count(order: list[Node]) -> None:
    """Characters and tags of each element, linked and all, bottom up."""
    for node in order:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
    for node in reversed(order):
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars = node.chars
        if up := node.parent:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")


def _spoken_against(node: Node, inside: bool) -> bool:
    """Whether more than a name says that an element isn't the article: links, controls, or that it has no paragraph,
    heading or, outside an article or main element, not both."""
    order = _under(node)
    tags = {n.tag for n in order}
    if tags & _CONTROLS:
        return True
    chars = linked = 0
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        x, link = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                chars += n
                linked += n * link
            else:
                todo.append((c, link or c.tag == "a"))
    prose, headed = "p" in tags, bool(tags & _HEADINGS)
    return 3 * linked >= chars or not (prose or headed if inside else prose and headed)


def _weigh(root: Node) -> list[Node]:
    """The elements, parents first, counted; those that aren't the article by their tag or name are cut."""
    order = _under(root)
    # what an element holds: 2 a page's main part, 1 an article
    holds = {id(n): 2 if n.tag in ("main", "body", "h1") else 1 if n.tag == "article" and n.says == _PLAIN else 0 for n in order}
    plain: dict[int, int] = {}
    inside_article, inside_main = {id(root): False}, {id(root): False}
    for node in order[1:]:
        inside_article[id(node)] = inside_article[id(node.parent)] or node.parent.tag == "article"
        inside_main[id(node)] = inside_main[id(node.parent)] or (node.parent.tag in MAIN and node.parent.says < _COMMENT)
    for node in reversed(order):
        if node.tag not in DROPPED or node.tag == "form":
            plain[id(node)] = sum(len(c) for c in node.children if isinstance(c, str)) + sum(plain.get(id(c), 0) for c in node.children if isinstance(c, Node))
        if node.parent:
            holds[id(node.parent)] = max(holds[id(node.parent)], holds[id(node)])

    def goes(node: Node) -> bool:
        if node.tag == "form":  # some pages are one form
            return 2 * plain[id(node)] < plain[id(root)]
        if node.tag in DROPPED:  # an article's own header is the title
            return not (node.tag == "header" and inside_article[id(node)] and any(isinstance(c, Node) and c.tag in _HEADINGS for c in node.children))
        if node.says in _STAYS:
            return holds[id(node)] < _STAYS[node.says] and (node.says != _TOPIC or _spoken_against(node, inside_main[id(node)]))
        return node.says == _HIDDEN

    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]
    order = _under(root)
    _count(order)
    return order


def _score(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        n.density = 0.0
        if n.chars:
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            ratio = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            if ratio > 1:  # without any link the base is 1, which has no logarithm
                n.density = n.chars / max(n.tags, 1) * math.log(ratio) / max(math.log(base), 0.1)
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node)) or n.density


def _titles(node: Node) -> bool:
    """Whether an element is a heading of the first two ranks, or holds a page's title and little more."""
    if node.tag in ("h1", "h2"):
        return True
    found = next((n for n in _under(node) if n.tag == "h1"), None)
    return found is not None and 2 * found.chars >= node.chars


def main_part(root: Node) -> Node:
    """The tree of the page's article: what isn't of the core, nor goes with it, is cut."""
    order = _weigh(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars:
        body = root
    _score(order, body)
    # parents come first, so of equal sums the outermost element is the core
    core = max((n for n in _under(body) if n.tag not in INLINE), key=lambda n: n.total)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    own = next((k for k in reversed(range(len(path))) if path[k].tag in MAIN), -1)

    titled = False  # a heading before the core has been found
    for k in range(1, len(path)):
        within = k <= own
        goes_on: set[int] = set()
        if own < 0 and not titled and path[k - 1].tag not in _HEADINGS:
            inner = [c for c in path[k].children if isinstance(c, Node)]
            at = inner.index(path[k - 1])
            heads = [i for i in range(at) if _titles(inner[i])]
            if heads:
                titled = True
                goes_on = {id(c) for c in inner[heads[-1] : at]} | {id(c) for c in inner[at + 1 :] if c.tag in _TEXTUAL}

        def kept(c: Node | str, node: Node = path[k - 1], within: bool = within, goes_on: set[int] = goes_on) -> bool:
            if isinstance(c, str):
                return within or len("".join(c.split())) >= max(threshold, 1.0)
            if c is node:
                return True
            if 2 * c.link_chars >= c.chars:
                return (within or id(c) in goes_on) and c.tag in _HEADINGS
            return within or id(c) in goes_on or c.density >= (threshold if own < 0 or c.tag == "article" else max(threshold, path[own].density))

        path[k].children = [c for c in path[k].children if kept(c)]
    return body


def _blocks(root: Node) -> Iterator[str]:
    """The text of each block: references decoded, white space one space."""
    held: list[str] = []
    todo: list[Node | str | None] = [root]  # None: a block's edge
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            if text := " ".join(html.unescape("".join(held)).split()):
                yield text
            held = []
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            todo += [None, *reversed(x.children), None]
    if text := " ".join(html.unescape("".join(held)).split()):
        yield text


def main_text(page: str) -> str:
    """The page's article, its blocks in page order joined by a line break; empty if there is none."""
    return "\n".join(_blocks(main_part(parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for each row of `pages` (page_id, url, html, any others).

    A null or empty html, or one without article text, gives an empty text; a text without any tag is one
    block. Whole pages are read, and nothing is capped. Of elements with equal density sums the outermost, then the last in the
    page, is the core. Repeated rows stay rows; nulls in other columns pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column("html").to_pylist()]
                out = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
