"""HTML extraction by tree scoring.

Paragraphs pass points for length and commas to their ancestors, each sum is discounted by link density, and the best
container is kept with those siblings that score like it. An article or main element has points of its own, as many as a
good paragraph, so that it wins over its like but not over a long story beside it; if the best container lies in an
article, or else in a main element, that element is kept whole.

Left out, inside the container too: menus, headers (but for their headings and, in an article, long paragraphs without
links), footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. A form that holds more prose than
all that lies outside of forms is the page's wrapper, of which only labels and controls are left out. Tags and roles tell them, and class names or ids made of nothing but words for such
parts ("cookie-notice", "left-sidebar"). A name that only has such a word among others ("market-share") counts where
link density agrees: over half of the text in links. Nothing else inside the container is dropped. Blocks that are
mostly links and stand beside the articles of a main element, or straight in the body, are menus.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one line feed. The whole html is read in linear time; nothing is capped.

Defined results: null or empty html, and pages without text, give an empty text. Broken markup is read as it comes:
unclosed and stray tags never fail. Rows that repeat give equal rows; a null id or url stays null. An empty table gives
an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import picked, shipped, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, besides an open paragraph for blocks: the tag, and where the search stops.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ENDS = {k: (frozenset(a.split()), b) for k, (a, b) in ENDS.items()}
DROPPED = frozenset("head nav footer aside button input select option menu dialog svg canvas audio video".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words for what isn't the article.
UNLIKELY = frozenset("ad ads advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promotion banner sidebar comment comments commentlist disqus respond replies reply notice notices cookie cookies consent gdpr popup modal overlay share sharing social related recommended recommendations newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager widget widgets login search skip feedback alert tags hidden rail rightbar leftbar outbrain taboola".split())
#: Words that may stand beside them in a name without changing what it says.
LAYOUT = frozenset("area bar block body bottom box btn button buttons col column container content count end footer form global group header holder icons inner item items js left link links list main message more outer page panel posts primary region right row secondary section side site slot sticky text thread title top unit wrap wrapper zone".split())
#: Those that tell even of an article element that it is not the page's.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments reply replies respond related recommended recommendations".split())
#: Parts of a class name that say what else a page has, not what the element is.
BESIDE = frozenset("has with no without".split())
#: Class names of page headers; of one inside an article only the headings are kept.
HEADERS = frozenset("header siteheader pageheader topheader mainheader articleheader entryheader postheader".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?(?P<end>)(?P<name>(?!))?(?P<attrs>)(?P<cdata>(?!))?", re.S)
TAG_START = re.compile(r"</?[a-zA-Z]")
#: For the rest of a page after a tag whose quotes are never closed.
PLAIN = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>|(?P<cdata>(?!))")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: Points that an article or main element has by itself, and that a form's prose has at least to be the page's.
SEMANTIC_POINTS, FORM_POINTS = 6.0, 5.0
#: Characters of a paragraph that counts whole, and of one that stands for itself.
PARAGRAPH, PROSE = 25, 80


class Node:
    __slots__ = ("tag", "parent", "children", "score", "chars", "linked", "commas", "drop", "shut", "named", "head", "cls")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.score = self.chars = self.linked = self.commas = 0
        self.drop, self.shut = tag in DROPPED, False
        self.named, self.head, self.cls = 0, tag == "header", ""


def _named(own: str) -> int:
    """2: a class name or id of nothing but words for what isn't the article; 1: one that has such a word; else 0."""
    parts = [x.lower() for x in NAME_PART.findall(own)]
    if BESIDE.intersection(parts) or UNLIKELY.isdisjoint(parts):
        return 0
    return 2 if all(x in UNLIKELY or x in LAYOUT for x in parts) else 1


def _told(node: Node, attrs: str) -> None:
    """Note what the attributes of a node say of it."""
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if name == "class":
                node.cls = value
            for own in value.split():
                parts = {x.lower() for x in NAME_PART.findall(own)}
                if node.tag == "main" or node.tag == "article" and parts.isdisjoint(NO_ARTICLE):
                    continue
                node.named = max(node.named, _named(own))
                node.head |= "".join(x.lower() for x in NAME_PART.findall(own)) in HEADERS
        elif name == "role":
            node.drop |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.drop = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.drop = True


class _Open:
    """The open elements: which stand where is looked up, not searched for, so that deep nesting costs no more."""

    def __init__(self) -> None:
        self.path = [Node("#root", None)]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.path))
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Close the element at a depth and all inside it."""
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def last(self, tag: str) -> int:
        return self.depths[tag][-1] if self.depths[tag] else 0

    def end(self, name: str) -> None:
        depth = self.last(name)
        if depth and (name in BLOCK or depth > self.blocks[-1]):  # an inline end tag closes nothing outside its block
            self.close(depth)

    def make_room(self, name: str) -> None:
        """Close what a start tag ends."""
        if name in BLOCK and self.path[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if name == "a" and self.last("a") > self.blocks[-1]:
            self.close(self.last("a"))
        if name in ENDS:
            tags, stop = ENDS[name]
            floor = max(map(self.last, stop))
            within = [d[k] for d in map(self.depths.__getitem__, tags) if (k := bisect_right(d, floor)) < len(d)]
            if within:
                self.close(min(within))


def parse(html: str) -> Node:
    """The tree of a page: nodes and decoded strings."""
    open_ = _Open()
    root = open_.path[0]
    at, end, plain = 0, len(html), False

    def text(s: str) -> None:
        if s:
            open_.path[-1].children.append(unescape(s) if "&" in s else s)

    while at < end:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        m = (COMMENT if plain else TOKEN).match(html, start)
        if not m and TAG_START.match(html, start):
            plain, m = True, PLAIN.match(html, start)
            if not m:  # no > is left
                break
        if not m:  # a sign, not markup
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = m.end()
        if m["cdata"]:
            open_.path[-1].children.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            open_.end(name)
            continue
        open_.make_room(name)
        if name in ("html", "body") and open_.last(name):
            continue
        node = Node(name, open_.path[-1])
        if m["attrs"]:
            _told(node, m["attrs"])
        if name in ("html", "body"):
            node.drop, node.named, node.head = False, 0, False
        elif name in ("article", "main"):
            node.drop = False
        open_.path[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif name not in VOID and not (m["attrs"].endswith("/") and name in ("svg", "path")):  # html knows no empty elements but the void ones
            open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, each after its parent."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _gone(node: Node, strict: bool) -> bool:
    """Whether a measured node is left out. strict: class names count."""
    return node.head or node.drop or node.shut or strict and (node.named == 2 or node.named == 1 and _density(node) > 0.5)


def _measure(nodes: list[Node], strict: bool) -> None:
    for n in nodes:
        n.score = n.chars = n.linked = n.commas = 0
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
                n.commas += c.count(",") + c.count("，") + c.count("、")
        if n.tag == "a":
            n.linked = n.chars
        if n.parent is not None and not _gone(n, strict):
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.commas += n.commas


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _paragraphs(nodes: list[Node]) -> Iterator[Node]:
    """Elements whose own text makes a paragraph: p, pre, quotes, cells, and others that hold text and no block."""
    for n in nodes:
        if n.tag in ("p", "pre", "blockquote", "td", "li", "dd") or n.tag in ("div", "section", "article", "main", "center", "body") and not any(isinstance(c, Node) and c.tag in BLOCK for c in n.children):
            yield n


def _points(n: Node) -> float:
    return (1 + n.commas + min(n.chars / 100, 3) if n.chars >= PARAGRAPH else n.chars / 100) * (1 - _density(n))


def _best(nodes: list[Node], alive: set[int]) -> Node | None:
    scored = []
    for n in _paragraphs(nodes):
        if id(n) not in alive or n.chars < 1:
            continue
        points = _points(n)
        node, share = n.parent if n.tag in ("p", "li", "dd", "td", "pre", "blockquote") else n, 1.0
        for level in range(5):
            if node is None or node.tag == "#root" and level:
                break
            if not node.score:
                scored.append(node)
            node.score += points * share
            node, share = node.parent, 1 / (2 * (level + 1))
    for n in nodes:
        if n.tag in ("article", "main") and id(n) in alive and n.chars:
            if not n.score:
                scored.append(n)
            n.score += SEMANTIC_POINTS
    return max(scored, key=lambda n: n.score * (1 - _density(n)), default=None)


def _shut_forms(nodes: list[Node], strict: bool) -> None:
    """Close all forms but one that wraps the page, and the labels of that."""
    forms = [n for n in nodes if n.tag == "form"]
    if not forms:
        return
    within: dict[int, Node | None] = {}
    for n in nodes:
        n.shut = False
        within[id(n)] = n if n.tag == "form" else within[id(n.parent)] if n.parent is not None else None
    for n in nodes:
        n.shut = n.tag in ("label", "legend") and within[id(n)] is not None
    _measure(nodes, strict)
    alive, points = _alive(nodes, strict), defaultdict(float)
    for n in _paragraphs(nodes):
        if id(n) in alive and n.chars >= PARAGRAPH:
            points[id(within[id(n)])] += _points(n)
    for f in forms:
        f.shut = points[id(f)] <= max(FORM_POINTS, points[id(None)])


def _alive(nodes: list[Node], strict: bool) -> set[int]:
    alive: set[int] = set()
    for n in nodes:
        if (n.parent is None or id(n.parent) in alive) and not _gone(n, strict):
            alive.add(id(n))
    return alive


def _whole(best: Node) -> Node:
    """The outermost article around a container, itself included, or else the outermost main element, or else itself."""
    around: dict[str, Node] = {}
    node: Node | None = best
    while node is not None:
        around[node.tag] = node
        node = node.parent
    return around.get("article") or around.get("main") or best


def _menus(container: Node, strict: bool) -> set[int]:
    """Blocks of a container that are mostly links: those beside the articles of a main element, those straight in a body."""
    listed = lambda n: n.tag in ("ul", "ol", "dl", "div", "section", "table") and n.chars and _density(n) > 0.5
    if container.tag in ("body", "html", "#root"):
        return {id(n) for n in container.children if isinstance(n, Node) and listed(n)}
    inside = _order(container)
    if container.tag != "main" or not any(n.tag == "article" and n.chars and not _gone(n, strict) for n in inside):
        return set()
    own: set[int] = set()
    for n in inside:
        if n is container or id(n.parent) in own and n.tag != "article":
            own.add(id(n))
    return {id(n) for n in inside if id(n) in own and listed(n)}


def _kept(root: Node, strict: bool) -> tuple[list[Node], set[int]]:
    """The best container, or it and its siblings, in page order; and the menus in it."""
    nodes = _order(root)
    _shut_forms(nodes, strict)
    _measure(nodes, strict)
    best = _best(nodes, _alive(nodes, strict))
    if best is None:
        return [], set()
    best = _whole(best)
    if best.parent is None:
        return [best], _menus(best, strict)
    out = []
    for s in best.parent.children:
        if s is best:
            out.append(s)
        elif isinstance(s, Node) and not _gone(s, strict):
            bonus = 0.2 * best.score if s.cls and s.cls == best.cls else 0
            like = s.tag == best.tag and s.chars > 0 and _density(s) <= 0.5 and s.score * (1 - _density(s)) + bonus >= 0.2 * best.score
            prose = s.tag == "p" and (s.chars > PROSE and _density(s) < 0.25 or s.chars > 0 and not s.linked)
            prose |= best.parent.tag == "main" and s.tag in ("div", "section", "blockquote") and s.chars > PROSE and _density(s) < 0.25
            heading = s.tag in HEADINGS and s.chars > 0
            if like or prose or heading:
                out.append(s)
    return out, _menus(best, strict)


def _blocks(kept: list[Node], menus: set[int], strict: bool) -> Iterator[str]:
    own: list[str] = []
    todo: list = list(reversed(kept))
    first = {id(n) for n in kept}
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            own.append(x)
            continue
        if x is None:
            if block := " ".join("".join(own).split()):
                yield block
            own.clear()
            continue
        if x.tag in ("br", "wbr"):
            own.append(" " if x.tag == "br" else "")
            continue
        if id(x) not in first:
            if x.head:  # an article's own header keeps its headings and what stands for itself
                todo.append(None)
                todo.extend(h for h in reversed(_order(x)) if h.tag in HEADINGS or h.tag == "p" and h.chars > PROSE and _density(h) < 0.25)
                todo.append(None)
                continue
            if _gone(x, strict) or id(x) in menus:
                continue
        if x.tag in BLOCK:
            todo.append(None)
            todo.extend(reversed(x.children))
            todo.append(None)
        else:
            todo.extend(reversed(x.children))
    if block := " ".join("".join(own).split()):
        yield block


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    for strict in (True, False):  # where class names leave nothing, they were misread
        if out := "\n".join(_blocks(*_kept(root, strict), strict)):
            return out
    return "\n".join(_blocks([root], set(), False))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [extract(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    base = picked(pages, id_col, url_col, html_col).select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kinds = [base.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return shipped(base).mapInArrow(_extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    return extract_pages(table(spark, sf_dir, "pages"))
