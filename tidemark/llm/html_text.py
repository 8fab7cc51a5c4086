"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters per tag, adjusted for how much of them is link text; a node's density
sum is that of its children. The subtree of the largest sum is the article, widened by neighbours on its path to the
body whose density reaches the least density on that path. What a page says is not article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, reader comments) is taken out before densities are computed.

Blocks are joined by one newline; white space in a block, line breaks included, becomes one space. Null, empty and
textless pages give an empty text; broken markup is read as browsers do where that matters (implied ends, unclosed
elements), and long pages in whole. Repeated rows are read one by one.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import per_text

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Element names of HTML by how they nest.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that a start tag of the key ends, if open, up to those in the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
NOT_ARTICLE = frozenset("head nav header footer aside form button select input label svg canvas audio video object menu dialog search fieldset".split()) | RAW
# Parts of class names and ids that name what is not the article.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup signin login share sharing social comments comment disqus respond reply replies "
    "breadcrumb breadcrumbs pagination pager notice notices alert alerts notification disclaimer paywall related recommended recommendations".split()
)
SELDOM = frozenset("nav navbar navigation menu menus sidebar sidebars sidenav header masthead footer banner topbar toolbar widget widgets search copyright skip toc".split())
SPARED = frozenset("content main article entry story post with has no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
KEPT_TAGS = frozenset("html body main article".split())


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "out", "order", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, out: bool, order: int):
        self.tag, self.parent, self.out, self.order = tag, parent, out, order
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        if parent is not None:
            parent.children.append(self)


def _not_article(tag: str, attributes: str) -> bool:
    if tag in NOT_ARTICLE:
        return True
    if not attributes or tag in KEPT_TAGS:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(one)}
                if parts & NEVER or parts & SELDOM and not parts & SPARED:
                    return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> tuple[Node, list[Node], list[tuple[Node, str]]]:
    """The root, all nodes in page order, and the article's candidate texts: (node, text). A text's node order tells blocks apart."""
    root = Node("html", None, False, 0)
    nodes, texts, stack = [root], [], [root]
    at, n = 0, len(page)
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    blocks: list[int] = []

    def text(a: int, b: int) -> None:
        node = stack[-1]
        if b > a and not node.out:
            texts.append((node, page[a:b]))

    def push(node: Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)

    def innermost(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()
        del stack[k:]
        texts.append((stack[-1], ""))  # a boundary; blank for inline ones

    search = _TOKEN.search
    last = page.rfind(">") + 1
    while at < n:
        m = search(page, at, last)
        if m is None:
            cut = re.compile(r"<[a-zA-Z/!?]").search(page, max(at, last))
            text(at, cut.start() if cut else n)
            break
        text(at, m.start())
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, max(at - 3, m.start() + 9))
            continue
        tag = tag.lower()
        if close:
            if k := innermost({tag}):
                pop_to(k)
            continue
        if tag in ("html", "body") and any(s.tag == tag for s in (root, *stack[1:2])):
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            pop_to(blocks[-1])
        if tag in ENDS:
            ended, limits = ENDS[tag]
            limit = innermost(limits)
            while (k := innermost(ended)) > limit:
                pop_to(k)
                if tag != "tr":
                    break
        parent = stack[-1]
        node = Node(tag, parent, parent.out or _not_article(tag, attributes), len(nodes))
        nodes.append(node)
        if tag == "br":
            texts.append((node, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            push(node)
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        push(node)
    return root, nodes, texts


def _densities(root: Node, nodes: list[Node], texts: list[tuple[Node, str]]) -> Node:
    """Fills in counts, densities and sums; gives the body."""
    for node, t in texts:
        node.chars += len(t) - t.count(" ") - t.count("\n")
    for node in reversed(nodes):
        if node.out:
            continue
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if (p := node.parent) is not None:
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.out or not node.chars:
            continue
        c, lc = node.chars, node.link_chars
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        value = c / max(lc, 1) * max(node.tags, 1) / max(node.link_tags, 1)
        node.density = c / max(node.tags, 1) * (math.log(value) / math.log(base) if base > 1 else math.log(value)) if value > 1 else 0.0
    for node in nodes:
        node.sum = sum(x.density for x in node.children)
    return body


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    root, nodes, texts = parse(page)
    body = _densities(root, nodes, texts)
    live = [x for x in nodes if not x.out and x.chars and x.parent is not None] or [body]
    best = max(live, key=lambda x: (x.sum, x.density, -x.order))
    chosen = {id(best)}
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    article = next((x for x in reversed(path) if x.tag == "article"), None) or next((x for x in reversed(path) if x.tag == "main"), None)
    if article is not None:
        chosen.add(id(article))
    else:
        least = min(x.density for x in path)
        for ancestor in path[1:]:
            chosen |= {id(x) for x in ancestor.children if x.density >= least and 2 * x.link_chars <= x.chars}
            if ancestor.chars - best.chars and any(t[0] is ancestor and t[1].strip() for t in texts):
                chosen.add(-id(ancestor))  # its own loose text
    inside: dict[int, bool] = {}
    for x in nodes:
        inside[id(x)] = not x.out and (id(x) in chosen or x.parent is not None and inside[id(x.parent)])
    blocks, part, holder = [], [], None

    def owner(x: Node) -> Node:
        while x.tag not in BLOCKS and x.parent is not None:
            x = x.parent
        return x

    owners: dict[int, Node] = {}
    for node, t in texts:
        own = owners.get(id(node)) or owners.setdefault(id(node), owner(node))
        if own is not holder:
            blocks.append(part)
            part, holder = [], own
        if inside[id(node)] or -id(node) in chosen:
            part.append(t)
    blocks.append(part)
    return "\n".join(s for b in blocks if (s := " ".join(html.unescape("".join(b)).split())))


def _texts(pages: list[str | None]) -> list[tuple]:
    out = []
    for p in pages:
        t = main_text(p)
        out.append((t, len(t)))
    return out


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages without the column page, with text and n_chars; columns of these names give way."""
    return per_text(pages, "text string, n_chars bigint", _texts, page, keep=[c for c in pages.columns if c != page])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
