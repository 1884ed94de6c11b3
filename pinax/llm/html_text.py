"""Main text of web pages by tree scoring (operator 10).

A page becomes a tree of blocks.  Each paragraph scores points for its length
and commas and passes them to its ancestors, the nearer the more; a
container's points are discounted by its share of link text.  The best
container is kept, with every block beside it that is not mostly links, however
short, up to the main or content container or the body that holds them.

Cases: a null, empty or textless page gives an empty text.  Unclosed and
misnested tags close with their container; a head closes at what cannot stand
in it.  Declarations and marked sections are no text, and a comment, declaration
or tag that the page's end cuts off is left out.  A header is dropped unless it
stands in an article, whose heading it holds.  Pages are independent, so
repeated rows give equal results.  Input columns that carry an output's name are
replaced.  The work grows in proportion to a page, however deep its nesting,
which is held in lists and not on Python's stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from .common import as_struct_type, blocks, without

#: Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = set("script style noscript template head title iframe object svg canvas math audio video".split())
#: Start tags that do not close an open head.
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
BOILERPLATE = set("nav header footer aside button select textarea menu dialog".split())
BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
            "h6 hr html li main ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = set("article body center div html main section td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = set("p".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
NOT_TEXT_NAME = re.compile(
    r"(?:^|[_-])(?:ad|ads|ad(?:banner|block|box|sense|slot|space|unit)s?|advert\w*|alerts?|banner|breadcrumbs?|"
    r"comments?|cookies?|consent|discussion|disqus|footer|gdpr|header|masthead|menu\w*|modal|nav\w*|newsletter|"
    r"notices?|notifications?|pager|pagination|popup|promo\w*|related|replies|respond|share\w*|sharing|side-?bar|"
    r"skip|social\w*|sponsor\w*|subscribe\w*|toolbar|widgets?)(?:$|[_-])", re.I)
#: Names that say what a page has or has not, or how a part of it stands.
STATE_NAME = re.compile(r"(?:has|is|no|not|with|without)[_-]|.*[_-](?:open|opened|closed|enabled|disabled)$", re.I)
TEXT_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
COMMENT_END = re.compile(r"--!?>")
#: References to numbers that no character has (the parser would read them digit by digit), and needless zeros.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,}")


def _furniture(name: str) -> bool:
    """Whether a token of a class or an id names page furniture."""
    return any(NOT_TEXT_NAME.search(x) and not STATE_NAME.match(x) for x in name.split())


class Node:
    __slots__ = ("no", "tag", "parent", "dropped", "named", "score", "length", "links", "soft", "plain", "anchor")

    def __init__(self, no: int, tag: str, parent: Node | None, dropped: bool, named: int):
        self.no = no  # place among the page's nodes; a parent stands before its children
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.score, self.length, self.links = float(named), 0, 0
        self.soft = False   # a form, or named like furniture: dropped unless it holds the page's text
        self.plain = False  # an article or main that is not named like furniture
        self.anchor = ""    # the id of a section that only its id names so


class Tree(HTMLParser):
    """Nodes of a page and its texts ``(node, text, length of link text)`` in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(0, "#page", None, False, 0)]
        self.path = [self.nodes[0]]
        self.open: dict[str, list[int]] = {}  # places on the path of each tag's open nodes
        self.holders: list[int] = []          # places on the path of open containers
        self.texts: list[tuple[Node, str, int]] = []
        self.parts: list[str] = []
        self.in_link = self.link_chars = 0

    @property
    def node(self) -> Node:
        return self.path[-1]

    def enter(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.path))
        if node.tag in CONTAINER:
            self.holders.append(len(self.path))
        self.path.append(node)
        self.nodes.append(node)

    def shut(self, at: int) -> None:
        """Close the open nodes from a place on the path on."""
        while len(self.path) > at:
            tag = self.path.pop().tag
            self.open[tag].pop()
            if tag in CONTAINER:
                self.holders.pop()

    def is_open(self, tag: str) -> int:
        """Place on the path of the last open node with this tag, 0 if there is none."""
        at = self.open.get(tag)
        return at[-1] if at else 0

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.texts.append((self.node, text, self.link_chars))
        self.parts, self.link_chars = [], 0

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i + 4) + 1
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        end = "]]>" if self.rawdata[i:i + 9].upper() == "<![CDATA[" else ">"
        at = self.rawdata.find(end, i + 3)
        return at + len(end) if at >= 0 else -1

    def leave_head(self, tag: str) -> None:
        """Close an open head at what cannot stand in it, as its end tag is optional."""
        head = self.is_open("head")
        if head > self.is_open("template") and tag not in IN_HEAD and (tag == "body" or head == len(self.path) - 1):
            self.parts = []
            self.shut(head)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.leave_head(tag)
        if tag == "a":
            self.in_link += 1
        if tag == "br":
            self.parts.append(" ")
        special = tag in NO_TEXT or tag in BOILERPLATE
        if tag not in BLOCK and not special and tag != "form":
            return
        self.flush()
        if tag in VOID:
            return
        while self.node.tag in CLOSED_BY_BLOCK and tag in BLOCK:
            self.shut(len(self.path) - 1)
        if tag in ("li", "dd", "dt", "tr", "td", "th") and self.node.tag == tag:
            self.shut(len(self.path) - 1)
        titles = tag == "header" and self.is_open("article") > 0
        special = special and not titles
        a = {k: v or "" for k, v in attrs}
        name = f"{a.get('class', '')} {a.get('id', '')}"
        dropped = (self.node.dropped or special or a.get("role", "").lower() in ROLES or "hidden" in a
                   or a.get("aria-hidden", "").lower() == "true")
        top = tag in ("article", "main") or a.get("role") == "main"
        named = 25 if top else 10 if TEXT_NAME.search(name) else 0
        furniture = _furniture(name)
        self.enter(Node(len(self.nodes), tag, self.node, dropped, 0 if dropped else named))
        self.node.plain = top and not furniture
        self.node.soft = (tag == "form" or a.get("role", "").lower() == "form"
                          or (furniture and not titles and tag not in HEADINGS
                              and tag not in ("html", "body", "article", "main")))
        if tag == "section" and self.node.soft and not _furniture(a.get("class", "")):
            self.node.anchor = a.get("id", "").lower()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag not in BLOCK and tag not in NO_TEXT and tag not in BOILERPLATE and tag != "form":
            return
        self.flush()
        at = self.is_open(tag)
        # A paragraph's end does not close the container around it.
        if at and not (tag in CLOSED_BY_BLOCK and self.holders and self.holders[-1] > at):
            self.shut(at)
            self.in_link = 0

    def handle_data(self, data: str) -> None:
        if self.node.tag == "head" and data.strip():
            self.leave_head("#text")
        if self.node.dropped:
            return
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(data.strip())

    def close(self) -> None:
        if not self.cdata_elem and re.match(r"<[!?/a-zA-Z]", self.rawdata):
            self.rawdata = ""  # cut off by the page's end
        super().close()
        self.flush()


def _drop_furniture(tree: Tree) -> None:
    """Drop the soft nodes that do not hold the page's text.

    A form or an element named like furniture stays if it holds a plain article
    or main, if it is a section whose id repeats its heading, or if it holds
    more than half of the page's text outside links while no article, main or
    element named like text that lies apart from it has a tenth as much.
    """
    nodes = tree.nodes
    own, last, holds = [0] * len(nodes), list(range(len(nodes))), [False] * len(nodes)
    headed: dict[int, str] = {}
    for node, text, links in tree.texts:
        own[node.no] += len(text) - min(links, len(text))
        if node.tag in HEADINGS and node.parent is not None:
            headed.setdefault(node.parent.no, re.sub(r"[\W_]+", "-", text.lower()).strip("-"))
    for n in reversed(nodes[1:]):
        i, up = n.no, n.parent.no
        own[up] += own[i]
        last[up] = max(last[up], last[i])
        holds[up] = holds[up] or holds[i] or (n.plain and not n.dropped and own[i] > 0)
    under = [False] * len(nodes)
    for n in nodes:
        under[n.no] = n.soft or n.dropped or (n.parent is not None and under[n.parent.no])
    # The most text of an article, main or node named like text that begins at a node or later, or ends before it.
    later, ended = [0] * (len(nodes) + 1), [0] * (len(nodes) + 1)
    for n in nodes:
        if (n.plain or n.named) and not under[n.no]:
            later[n.no] = own[n.no]
            ended[last[n.no] + 1] = max(ended[last[n.no] + 1], own[n.no])
    for i in range(len(nodes)):
        ended[i + 1] = max(ended[i + 1], ended[i])
        later[-2 - i] = max(later[-2 - i], later[-1 - i])
    for n in nodes[1:]:
        i = n.no
        if n.parent.dropped:
            n.dropped = True
        elif n.soft and not n.dropped and not holds[i] and not n.plain:
            chapter = n.anchor and not n.anchor.startswith(("comment", "repl")) and headed.get(i) == n.anchor
            apart = max(later[last[i] + 1], ended[i])
            n.dropped = not chapter and (2 * own[i] <= own[0] or (apart > 0 and 10 * apart >= own[i]))
    tree.texts = [x for x in tree.texts if not x[0].dropped]


def _score(tree: Tree) -> None:
    """Lengths, link lengths and points of all nodes, added up from the leaves."""
    nodes = tree.nodes
    whole, passed = [0.0] * len(nodes), [0.0] * len(nodes)  # points below a node; what of them reaches it
    for node, text, links in tree.texts:
        node.length += len(text)
        node.links += links
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, links / len(text)))
        # Paragraphs score; so does text that lies directly in a container.
        at = node if node.tag in CONTAINER else node.parent
        if at is not None:
            whole[at.no] += points
            passed[at.no] += points
    parts = [False] * len(nodes)  # holds a plain article with text
    for n in reversed(nodes):
        i = n.no
        # An article counts its parts in full, so no part of it outweighs it; so does a main without articles.
        full = n.tag == "article" or (n.plain and n.length > 0 and not parts[i])
        if n.tag in CONTAINER:
            n.score += whole[i] if full else passed[i]
            passed[i] /= 2
        if n.parent is not None:
            up = n.parent
            up.length += n.length
            up.links += n.links
            whole[up.no] += whole[i]
            passed[up.no] += passed[i]
            parts[up.no] = parts[up.no] or parts[i] or (n.tag == "article" and n.plain and n.length > 0)


def main_text(html: str | None) -> str:
    """The page's main text, a line for each block."""
    tree = Tree()
    tree.feed(TOO_LARGE.sub("&#65533", ZEROS.sub("&#", html or "")))
    tree.close()
    _drop_furniture(tree)
    if not tree.texts:
        return ""
    _score(tree)
    containers = [n for n in tree.nodes if n.tag in CONTAINER and n.length] or [tree.nodes[0]]
    worth = {n.no: n.score * (1 - min(1.0, n.links / max(1, n.length))) for n in containers}
    best = max(containers, key=lambda n: worth[n.no])
    least = max(10.0, worth[best.no] * 0.2)

    kept = [False] * len(tree.nodes)
    kept[best.no] = True
    for n in containers:
        if n.parent is best.parent and worth[n.no] >= least:
            kept[n.no] = True
    opened = _beside(tree, best, kept)
    for n in tree.nodes[1:]:
        kept[n.no] = kept[n.no] or kept[n.parent.no]
    return "\n".join(text for node, text, links in tree.texts
                     if kept[node.no] or (node.no in opened and 4 * links < len(text)))


def _beside(tree: Tree, best: Node, kept: list[bool]) -> set[int]:
    """Mark what stands beside the best container in ``kept``; the nodes whose own texts stand there.

    An article, a main or the body is whole.  Else the blocks beside it are a
    part of it unless a quarter of their text is links, and so are those beside
    its parent, up to a container that is named like text or the body; below a
    main, up to the main.
    """
    opened: set[int] = set()
    if best.plain or best.tag in ("article", "main", "body"):
        return opened
    children: dict[int, list[Node]] = {}
    for n in tree.nodes[1:]:
        children.setdefault(n.parent.no, []).append(n)
    at, in_main = best.parent, False
    while at is not None and not in_main:
        in_main, at = at.plain, at.parent
    at = best
    while at.parent is not None:
        up = at.parent
        for n in children[up.no]:
            if n is not at and 4 * n.links < n.length:
                kept[n.no] = True
        opened.add(up.no)
        named = at is best and at.named or up.named
        if up.plain or up.tag in ("body", "html", "#page") or 4 * up.links >= up.length or (named and not in_main):
            break
        at = up
    return opened


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html but with ``text`` and ``n_chars`` (its code points)."""
    pages = without(pages, [c for c in ("text", "n_chars") if c != html_col])
    shape = pages.drop(html_col)

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, html_col):
            at = rb.schema.get_field_index(html_col)
            found = [main_text(h) for h in rb.column(at).to_pylist()]
            yield (rb.remove_column(at).append_column("text", pa.array(found, pa.string()))
                   .append_column("n_chars", pa.array([len(t) for t in found], pa.int64())))

    return pages.mapInArrow(pull, as_struct_type(shape, ("text", StringType()), ("n_chars", LongType())))
