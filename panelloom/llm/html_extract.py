"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each element is content or not. Its tag, its class and id words and the shape of its text give evidence; a potential on each edge says how likely a
child is content given its parent. Messages pass from the leaves up and from the root down (sum-product, exact on a tree), and blocks whose marginal
is over one half are the text. All tables are counted on the labelled pages of html_pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P
from .html_pages import labelled_pages

#: How HTML treats these elements.
SILENT = frozenset("script style noscript template iframe object svg math head title textarea select datalist button option canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: An open element of these ends where one of the others begins.
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt legend summary".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
            "option": {"option"}}
#: What a head may hold; any other element ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: White space that HTML joins inside a block.
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "runs", "truth", "chars", "links", "up", "evidence")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.runs: list[str] = []
        self.chars = self.links = 0
        self.truth = 0


class Tree(HTMLParser):
    """Elements in block structure. Inline elements give their text to the block around them; text between blocks is a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", (), None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.count = Counter()  # open elements by tag, so that an end without a start costs nothing
        self.silent: list[str] = []
        self.silent_count = Counter()
        self.loose: Node | None = None
        self.blocks: list[tuple[Node, list[str]]] = []
        self.text: list[str] = []
        self.link = 0
        self.inside, self.outside = 0, 0

    def _flush(self):
        if self.text:
            self.blocks.append((self.loose or self.open[-1][1], self.text))
            self.text = []
        self.loose = None

    def _silence(self, tag: str):
        self.silent.append(tag)
        self.silent_count[tag] += 1

    # Markup that nothing closes takes the rest of the page, as in HTML, and is looked for once.

    def _ends(self, mark: str, i: int) -> bool:
        if mark not in self.last:
            self.last[mark] = self.rawdata.rfind(mark)
        return self.last[mark] >= i

    def feed(self, data):
        self.last: dict[str, int] = {}
        super().feed(data)

    def close(self):
        self.last = {}  # what is left of the page begins anew
        super().close()

    def parse_starttag(self, i):
        return super().parse_starttag(i) if self._ends(">", i) else len(self.rawdata)

    def parse_endtag(self, i):
        return super().parse_endtag(i) if self._ends(">", i) else len(self.rawdata)

    def parse_pi(self, i):
        return super().parse_pi(i) if self._ends(">", i) else len(self.rawdata)

    def parse_html_declaration(self, i):
        return super().parse_html_declaration(i) if self._ends(">", i) else len(self.rawdata)

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if self._ends("-->", i + 2) or self._ends("--!>", i + 2) else len(self.rawdata)

    def handle_starttag(self, tag, attrs):
        if self.silent and (self.silent == ["head"] and tag not in IN_HEAD or tag in BLOCK and self.silent_count["option"] == len(self.silent)):
            self.silent.clear()
            self.silent_count.clear()
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self._silence(tag)
            return
        if tag in SILENT:
            self._silence(tag)
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "a":
            self.link += 1
        if tag not in BLOCK:
            return
        self._flush()
        if tag in ("html", "body"):
            return
        if tag == "hr":
            return
        if tag in CLOSES_P:
            self._close("p")
        for own, ends in ENDED_BY.items():
            if tag in ends:
                self._close(own, within=True)
        names = tuple(sorted({w for k, v in attrs if k in ("class", "id", "role") and v for w in NAME.findall(v.lower())}))
        node = Node(tag, names, self.open[-1][1])
        node.truth = int(self.inside > 0 and not self.outside)
        self.open[-1][1].children.append(node)
        self.open.append((tag, node))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT and self.silent:
            self.silent_count[self.silent.pop()] -= 1

    def _close(self, tag: str, within: bool = False):
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._flush()
                self.count.subtract(t for t, _ in self.open[i:])
                del self.open[i:]
                return
            if within and self.open[i][0] in ("table", "ul", "ol", "dl", "select"):
                return
            if tag == "p" and self.open[i][0] in ("article", "section", "div", "main", "aside", "td", "li", "nav", "footer", "header", "form"):
                return

    def handle_endtag(self, tag):
        if self.silent:
            if self.silent_count[tag]:
                while True:
                    last = self.silent.pop()
                    self.silent_count[last] -= 1
                    if last == tag:
                        break
            return
        if tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in BLOCK and tag not in ("html", "body"):
            self._flush()
            self._close(tag)

    def handle_data(self, data):
        if self.silent:
            return
        for mark, step in (("\x01", (1, 0)), ("\x04", (-1, 0)), ("\x02", (0, 1)), ("\x03", (0, -1))):
            if self.marked and mark in data:
                self.inside += step[0]
                self.outside += step[1]
                data = data.replace(mark, "")
        node = self.open[-1][1]
        if node is self.root:
            if self.loose is None:
                if not data.strip():
                    return
                # Text straight in the body is a paragraph of its own.
                self.loose = Node("p", (), node)
                self.loose.truth = int(self.inside > 0 and not self.outside)
                node.children.append(self.loose)
            node = self.loose
        n = len(data) - data.count(" ")
        node.chars += n
        if self.link:
            node.links += n
        self.text.append(data)

    marked = False


def parse(html: str, marked: bool = False) -> tuple[Tree, list[Node]]:
    """The tree and its nodes, parents first. Broken markup never fails: what cannot be read is text."""
    tree = Tree()
    tree.marked = marked
    tree.feed(html)
    tree.close()
    tree._flush()
    nodes, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed(node.children)
    return tree, nodes


def _shape(node: Node) -> str:
    """Own text: how much there is, and how much of it is links."""
    size = min(6, int(math.log2(node.chars + 1) / 1.5)) if node.chars else -1
    share = node.links / node.chars if node.chars else 0
    return f"{size}/{0 if share < 0.2 else 1 if share < 0.7 else 2}"


class Model:
    """Log potentials. Unseen tags, words and shapes say nothing either way."""

    def __init__(self, pages: list[str]):
        tags, names, shapes, edges = Counter(), Counter(), Counter(), Counter()
        seen = [0, 0]
        for page in pages:
            _, nodes = parse(page, marked=True)
            for node in nodes:
                y = node.truth
                seen[y] += 1
                tags[node.tag, y] += 1
                shapes[_shape(node), y] += 1
                for name in node.names:
                    names[name, y] += 1
                if node.parent is not None:
                    # A child that differs from its parent has a cause in its own tag or names; those of a plain child rarely do.
                    edges[node.parent.truth, y] += 1
        self.edge = [[math.log((edges[p, y] + 1) / (edges[p, 0] + edges[p, 1] + 2)) for y in (0, 1)] for p in (0, 1)]
        prior = [math.log(s / sum(seen)) for s in seen]

        def ratios(counts: Counter, smooth: float) -> dict[str, float]:
            out = {}
            for key in {k for k, _ in counts}:
                a, b = counts[key, 1] + smooth, counts[key, 0] + smooth
                out[key] = math.log(a / b) - (prior[1] - prior[0])
            return out

        self.tags, self.names, self.shapes = ratios(tags, 0.5), ratios(names, 0.5), ratios(shapes, 2.0)

    def evidence(self, node: Node) -> float:
        """Log odds of content from the node alone."""
        return self.tags.get(node.tag, 0.0) + sum(self.names.get(n, 0.0) for n in node.names) + self.shapes.get(_shape(node), 0.0) * 0.5

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """Log odds of content of each node (by identity), by messages up and down. nodes: parents first."""
        e = self.edge
        up: dict[int, tuple[float, float]] = {}
        local = {id(n): [0.0, self.evidence(n)] for n in nodes}
        local[id(nodes[0])] = [0.0, -6.0]  # the page as a whole is not content
        for node in reversed(nodes):
            own = local[id(node)]
            if node.parent is not None:
                m = tuple(_add(e[p][0] + own[0], e[p][1] + own[1]) for p in (0, 1))
                up[id(node)] = m
                above = local[id(node.parent)]
                above[0] += m[0]
                above[1] += m[1]
        belief = {}
        for node in nodes:
            own = local[id(node)]
            if node.parent is not None:
                above, mine = local[id(node.parent)], up[id(node)]
                b0, b1 = above[0] - mine[0], above[1] - mine[1]
                top = max(b0, b1)
                down = [_add(b0 - top + e[0][y], b1 - top + e[1][y]) for y in (0, 1)]
                own[0] += down[0]
                own[1] += down[1]
            belief[id(node)] = own[1] - own[0]
        return belief


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


@cache
def trained() -> Model:
    return Model(labelled_pages())


def main_text(html: str | None, model: Model | None = None) -> str:
    """The blocks of main text in page order, joined by two newlines; empty where there is none."""
    if not html:
        return ""
    tree, nodes = parse(html)
    belief = (model or trained()).marginals(nodes)
    blocks = []
    for node, runs in tree.blocks:
        if belief[id(node)] > 0:
            text = SPACE.sub(" ", "".join(runs)).strip()
            if text:
                blocks.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) for their html; a null page has an empty text. Other columns stay."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = trained()
        for batch in batches:
            yield pd.Series([main_text(h, model) for h in batch], dtype=object)

    out = pages.withColumn(f"{P}text", text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
    return out.withColumn("text", F.col(f"{P}text")).withColumn("n_chars", F.length(f"{P}text").cast("long")).drop(f"{P}text")
