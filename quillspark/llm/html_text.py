"""Main text of HTML pages by composite text density.

A page is parsed to a tree with the end tags that HTML lets authors leave out, in time linear in its length. Scripts, styles and
parts that name themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments (by element, role, or a whole
name in class or id) leave the tree first; but a form, or a part
named only by its place or use, that holds half of the page's text is none. What
names do not tell, density decides. Tags that only style text (b, i, span, a, br, ...) are no nodes; they count as the tags of the block they
stand in. For every node

    density = C / T * log(C * T / (LC * LT)) / log(ln(C * LC / (C - LC) + LC_body * C / C_body + e))

with C characters, T tags, LC characters in links and LT links, each at least 1. The node with the largest sum of its
children's densities is the core; the smallest density on the path from it up to body is the threshold. From body down,
each node at or above the threshold marks its subtree of maximal sum. Under an outermost such node, the least node that holds
all marks is taken whole, and so is each node above it whose further text is not mostly links or that is an article or
main element. The blocks of what was chosen are returned whole, in page order.

Defined results: a null or empty page, or one with no text outside the removed parts, gives the empty string; broken, cut and
very deep markup is parsed without recursion; unknown character references stay as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, table, unpacked, with_own

#: Elements by what the parser does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
INLINE = frozenset(
    "math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
    " a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An element closed by the start of another of its kind, and where the search for it stops.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and roles that are not the article.
DROPPED = frozenset("nav footer aside script style noscript template iframe svg button select textarea input object embed head title menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Names in class or id of such parts. A name of several parts counts by its first or last part, or as a pair.
ALONE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar"
    " disqus cookie cookies consent notice notices gdpr newsletter subscribe popup modal share sharing social related recommended widget login signup pagination pager banner".split()
)
FIRST = frozenset("ad ads advert advertisement sponsor sponsored promo sidebar nav navbar menu breadcrumb breadcrumbs footer cookie cookies gdpr consent newsletter subscribe popup modal share sharing pagination".split())
LAST = frozenset("ad ads advert advertisement promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar consent notice notices newsletter popup modal banner widget pagination pager login signup".split())
PAIRS = frozenset("related-posts related-articles related-stories related-links related-content social-links social-media social-share social-icons social-buttons social-bar site-header page-header top-header main-header global-header skip-link skip-links".split())
COMMENTS = frozenset("comment comments commentlist replies respond disqus".split())
PLAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs".split())
DENIED = frozenset("no non not with without has have".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PARTS = re.compile(r"[-_]+")
NAMED, SURE, READERS = 1, 2, 3  # why a node is not the article: a name or a form; an element, role or plain name; comments of readers
#: Where the search for an open element of a kind stops. "p" is closed by the start of most blocks.
SCOPES = {"p": ({"p"}, {"td", "th", "table", "button"})} | {k: CLOSED_BY[k] for k in ("li", "dt", "tr", "td", "option")}
SCOPE_OF = {"dd": "dt", "th": "td"}
SCOPED = frozenset().union(*(a | b for a, b in SCOPES.values()))


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "chars", "tags", "link_chars", "links", "density", "total", "order", "near", "inside")

    def __init__(self, tag: str, parent: Node | None, drop: int):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], drop
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.near: dict[str, Node | None] = parent.near if parent is not None else {}
        if tag in SCOPED:  # the closest open element of each kind that a tag may close
            self.near = dict(self.near)
            for kind, (own, stop) in SCOPES.items():
                if tag in own:
                    self.near[kind] = self
                elif tag in stop:
                    self.near[kind] = None
        if parent is not None:
            parent.children.append(self)


def named(name: str) -> int:
    """What a class or id says of a part: whole names count, not letters inside them."""
    parts = [x for x in PARTS.split(CAMEL.sub("-", name).lower()) if x]
    if not parts or DENIED.intersection(parts):
        return 0
    if parts[0] in COMMENTS or parts[-1] in COMMENTS:
        return READERS
    if parts[0] in PLAIN or parts[-1] in PLAIN:
        return SURE
    if len(parts) == 1:
        return NAMED if parts[0] in ALONE else 0
    return NAMED if parts[0] in FIRST or parts[-1] in LAST or f"{parts[0]}-{parts[-1]}" in PAIRS else 0


def why_dropped(tag: str, attributes: str, parent: Node) -> int:
    if tag in DROPPED or tag == "header" and not parent.inside:
        return SURE
    why = NAMED if tag == "form" else 0
    if not attributes or tag in ("body", "html"):
        return why
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return SURE
        if name in ("class", "id") and tag not in ("article", "main"):
            why = max([why, *map(named, value.split())])
    return why


def path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree, and its pieces of text (node, text, in a link) in page order; a piece of a styled part has the block's node. A tag
    costs no walk up the tree, but for elements that it closes. A body tag after text was seen opens nothing. A link goes on through blocks if its end
    tag comes before another link, else it ends where a block begins or ends."""
    root = Node("html", None, 0)
    body, node, pieces, link, at, styled = root, root, [], 0, 0, []
    nodes, open_, whole, begun = [root], Counter(), False, False

    def text(a: int, b: int) -> None:
        nonlocal begun
        if b > a:
            pieces.append((node, page[a:b], link))
            begun = begun or not page[a:b].isspace()

    def closed(upto: Node) -> Node:
        """The parent of an open element, once that and all in it are closed."""
        x = node
        while x is not upto:
            open_[x.tag] -= 1
            x = x.parent
        open_[upto.tag] -= 1
        return upto.parent

    def opened(tag: str, why: int) -> Node:
        open_[tag] += 1
        nodes.append(Node(tag, node, why))
        return nodes[-1]

    find = TOKEN.search
    while m := find(page, at):
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        end, tag = m[1] == "/", m[2].lower()
        if tag in INLINE:
            if tag == "br":
                pieces.append((node, " ", link))
            if not end:
                node.tags += 1
                node.links += tag == "a"
            if tag not in VOID and not m[3].endswith("/"):
                # an opened part that may be dropped as a whole is a node after all
                if not end and m[3] and (why := why_dropped(tag, m[3], node)):
                    node = opened(tag, why)
                    styled.append(node)
                elif end and styled and styled[-1].tag == tag and styled[-1] is node:
                    node = closed(styled.pop())
                elif tag == "a":
                    link, whole = 0 if end else 1, not end and (to := LINK.search(page, at)) is not None and to[1] == "/"
            continue
        if end:
            if open_[tag] > 0:
                x = node
                while x.tag != tag:
                    x = x.parent
                node, link = closed(x), link * whole
            continue
        if tag in ("html", "head", "body"):
            if tag == "body" and body is root and not begun:
                node = body = Node("body", root, 0)
                nodes.append(body)
                open_.clear()
            continue
        if tag in RAW:
            foreign = tag in ("svg", "annotation", "annotation-xml")  # these may close themselves, and without an end tag hide nothing
            if not (foreign and m[3].endswith("/")):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else at if foreign else len(page)
            continue
        if tag in CLOSES_P:
            link *= whole
            if (x := node.near.get("p")) is not None:
                node = closed(x)
        if tag in CLOSED_BY and (x := node.near.get(SCOPE_OF.get(tag, tag))) is not None:
            node = closed(x)
        new = opened(tag, why_dropped(tag, m[3], node))
        new.links += link
        if tag not in VOID and not m[3].endswith("/"):
            node = new
        else:
            open_[tag] -= 1
    text(at, len(page))
    pardoned(nodes, pieces)
    return body, pieces


def pardoned(nodes: list[Node], pieces: list[tuple[Node, str, int]]) -> None:
    """A name alone doesn't drop a part that holds half of the page's text outside links and comments, or more."""
    if not any(x.drop == NAMED for x in nodes):
        return
    held = dict.fromkeys(nodes, 0)
    for node, text, link in pieces:
        if not link:
            held[node] += len(text.strip())
    for x in reversed(nodes):
        if x.drop in (SURE, READERS):
            held[x] = 0
        if x.parent is not None:
            held[x.parent] += held[x]
    for x in nodes:
        if x.drop == NAMED and 2 * held[x] >= held[nodes[0]] > 0:
            x.drop = 0


def measured(body: Node, pieces: list[tuple[Node, str, int]]) -> list[Node]:
    """Nodes that stay, parents first, with their counts, densities and sums."""
    for node, text, link in pieces:
        n = len(text) - text.count(" ") if text.isspace() else len(text.strip())
        node.chars += n
        node.link_chars += n * link
    nodes, todo = [], [body]
    while todo:
        x = todo.pop()
        if not x.drop:
            x.order = len(nodes)
            nodes.append(x)
            todo += reversed(x.children)
    for x in reversed(nodes):
        for c in x.children:
            if not c.drop:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.links += c.links
    all_chars, all_links = max(1, body.chars), body.link_chars
    for x in nodes:
        if x.chars:
            c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.links)
            base = math.log(c * lc / max(1, c - lc) + all_links * c / all_chars + math.e)
            x.density = max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt)) + 1) / math.log(base + 1))
    for x in nodes:
        x.total = sum(c.density for c in x.children if not c.drop) or x.density * 0.5
    return nodes


def chosen(nodes: list[Node]) -> set[Node]:
    """The nodes whose subtrees are the article."""
    core = max(nodes, key=lambda x: x.total)
    threshold = min(x.density for x in path(core) if not x.drop and hasattr(x, "order"))
    best: dict[Node, Node] = {}
    for x in reversed(nodes):
        best[x] = max([x, *(best[c] for c in x.children if c in best)], key=lambda y: y.total)
    dense = {x for x in nodes if x is not nodes[0] and x.chars and x.density >= threshold or x is core}
    marks, holds = {best[x] for x in dense}, {}
    for x in reversed(nodes):
        under = [holds[c] for c in x.children if c in holds]
        if x in marks or len(under) > 1:
            holds[x] = x
        elif under:
            holds[x] = under[0]
    out, todo = set(), [nodes[0]]
    while todo:
        x = todo.pop()
        if x in dense:
            whole = holds[x]
            for p in path(whole):
                if p.tag in ("article", "main") or 2 * (p.link_chars - whole.link_chars) <= p.chars - whole.chars:
                    whole = p
                if p is x:
                    break
            out.add(whole)
        else:
            todo += [c for c in x.children if not c.drop]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body, pieces = parse(page)
    nodes = measured(body, pieces)
    if not nodes or not nodes[0].chars:
        return ""
    take = chosen(nodes)
    kept: dict[Node, bool] = {}
    for x in nodes:
        kept[x] = x in take or kept.get(x.parent, False)
    blocks, last = [], None
    for node, text, _ in pieces:
        if kept.get(node):
            if node is not last:
                blocks.append([])
                last = node
            blocks[-1].append(text)
        elif not node.drop or node.tag not in INLINE:
            last = None
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """pages with main_text in place of html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    own = [c for c in pages.columns if c.lower() not in ("html", "text")]
    df = carried(pages, own, F.col("html"))
    return unpacked(df.mapInArrow(run, with_own(df, "text string")), own, "text")


def op1(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
