"""Main text of web pages by a tree-structured graphical model.

The block elements of a page, and inline ones with a class, id or role, are the nodes of a tree; each is content or not. A node's evidence are its tag, the words of
its class, id and role, the share of its text that lies in links, the length of its own text and its share of the page's; an edge holds how
content passes from parent to child. Both are estimated from labelled pages. Sum-product message passing, once upward and
once downward, gives the exact marginal of every node; text runs of nodes whose marginal is at least one half are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import rows_of

#: Fixed lists: elements inside a line of text, those without an end tag, and those whose content is no page text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea select button iframe object svg math canvas audio video head title option".split())
#: Fixed table: which open elements a start tag ends.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: Fixed lists for what hides text: foreign elements, those within them whose content is HTML again, the start tags that end
#: foreign content, those that may stand in a head, those that end an open select, and those that no button can hold.
FOREIGN = frozenset("svg math".split())
POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
ENDS_SELECT = frozenset("select input keygen textarea caption table tbody tfoot thead tr td th body".split())
ENDS_BUTTON = frozenset("button article main section nav aside header footer body".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|(?P<open><(script|style|textarea|title|noscript|iframe|template)(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*+>).*?(?:</\2\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|aria-label|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    """A block or named inline element: its parent's number, evidence, own text (characters), and the text of its subtree (characters, and
    those in links)."""

    parent: int
    tag: str
    words: tuple[str, ...] = ()
    chars: int = 0
    below: int = 0
    linked: int = 0
    label: int | None = None


def parse(page: str, labelled: bool = True) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The block nodes of a page, parents first, and its text runs as (node, block number, decoded text).

    `data-label` (0 or 1) is read from `labelled` pages alone: others use that attribute for purposes of their own.
    """
    nodes, runs = [Node(-1, "#root")], []
    stack: list[tuple[str, int]] = [("#root", 0)]
    #: open elements that hide text, and all that is open in foreign ones: name, open blocks before it, and for what is in
    #: foreign content the nearest foreign element or point of HTML in it
    hidden: list[tuple[str, int, str]] = []
    at, block, links = 0, 0, 0
    open_, shut = Counter(), Counter()  # how many of each element are in `stack` and in `hidden`

    def opened(tag: str, own: int) -> None:
        stack.append((tag, own))
        open_[tag] += 1

    def cut(k: int) -> None:
        """Take this place of the stack and all within it away."""
        for tag, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    def reveal(k: int) -> None:
        """Take this place of what is hidden and all within it away."""
        for tag, _, _ in hidden[k:]:
            shut[tag] -= 1
        del hidden[k:]

    def text(raw: str) -> None:
        if not raw:
            return
        if hidden and hidden[-1][0] == "head" and not raw.isspace():
            reveal(len(hidden) - 1)
        if hidden:
            return
        value = html.unescape(raw) if "&" in raw else raw
        own = stack[-1][1]
        runs.append((own, block, value))
        n = len(value.strip())
        nodes[own].chars += n
        nodes[own].below += n
        if links:
            nodes[own].linked += n

    def hide(tag: str) -> None:
        near = hidden[-1][2] if hidden else ""
        hidden.append((tag, len(stack), tag if tag in FOREIGN or near and tag in POINTS else near))
        shut[tag] += 1

    def show(*tags: str) -> bool:
        """Close the innermost of such elements and all within it."""
        if not any(shut[t] for t in tags):
            return False
        for k in range(len(hidden) - 1, -1, -1):
            if hidden[k][0] in tags:
                cut(max(hidden[k][1], 1))
                reveal(k)
                return True
        return False

    def close(k: int) -> None:
        """Close the block in this place of the stack and all within it."""
        cut(k)
        first = len(hidden)
        while first and hidden[first - 1][1] > k:
            first -= 1
        reveal(first)

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m.group(2):  # an element of raw text, which foreign content doesn't have
            tag = m.group(2).lower()
            if hidden and hidden[-1][2] in FOREIGN:
                at = m.end("open")
                if page[at - 2] != "/":
                    hide(tag)
            elif tag not in IN_HEAD:
                show("head")
                if tag in ENDS_SELECT:
                    show("select")
            continue
        tag = m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(3):
            if hidden and show(tag):
                continue
            if tag in ("body", "html", "br"):
                show("head")
            if tag == "optgroup" and hidden and hidden[-1][0] == "option":
                reveal(len(hidden) - 1)
            if tag == "a":
                links = max(links - 1, 0)
            if tag in OPAQUE:
                pass
            elif tag == "p" and not open_["p"]:
                block += 1
            elif tag not in INLINE:
                block += 1
                for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
            elif open_[tag]:  # an inline node ends within its block only
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        rest = m.group(5)
        if hidden:
            if hidden[-1][2] in FOREIGN and tag in BREAKOUT:
                while hidden and hidden[-1][2] in FOREIGN:
                    reveal(len(hidden) - 1)
            if hidden and hidden[-1][2]:
                if tag not in VOID and not rest.endswith("/"):
                    hide(tag)
                continue
        if hidden:
            if tag not in IN_HEAD:
                show("head")
            if tag in ENDS_SELECT and show("select") and tag == "select":
                continue
            if tag in ENDS_BUTTON:
                show("button")
            if tag in ("option", "optgroup") and hidden and hidden[-1][0] == "option":
                reveal(len(hidden) - 1)
        if tag == "head" and (nodes[0].chars or any(n.tag != "html" for n in nodes[1:4])):
            continue  # the body has begun
        if tag == "a":
            links += 1
        if tag == "br":
            text(" ")
        if tag in OPAQUE:
            if not rest.endswith("/"):
                hide(tag)
            continue
        if tag in VOID:
            block += tag not in INLINE
            continue
        if tag not in INLINE:
            block += 1
            inside = hidden[-1][1] if hidden else 1  # a start tag closes nothing beyond what hides it
            low = len(stack)
            while low > inside and stack[low - 1][0] in INLINE:
                low -= 1
            if tag in CLOSES:
                if any(open_[t] for t in CLOSES[tag]):
                    for k in range(len(stack) - 1, inside - 1, -1):
                        if stack[k][0] in _BARRIER[tag]:
                            break
                        if stack[k][0] in CLOSES[tag]:
                            cut(k)
            elif low > inside and stack[low - 1][0] == "p":
                cut(low - 1)
        words, label = [], None
        for name, value in _NAMES.findall(rest):
            if name.lower() == "data-label":
                if labelled and (given := value.strip("\"'")) in ("0", "1"):
                    label = int(given)
            else:
                words.extend(w.lower() for w in _WORD.findall(value))
        if tag in INLINE and not words and label is None:
            continue  # without a name of its own it's part of its block
        nodes.append(Node(stack[-1][1], tag, tuple(dict.fromkeys(words)), label=label))
        opened(tag, len(nodes) - 1)
    text(page[at:])
    for node in reversed(nodes[1:]):
        nodes[node.parent].below += node.below
        nodes[node.parent].linked += node.linked
    return nodes, runs


def evidence(node: Node, whole: int) -> list[str]:
    """Features of a node of a page with so many characters."""
    share = node.linked / node.below if node.below else 0
    links = 0 if share < 0.2 else 1 if share < 0.6 else 2
    part = node.below / whole if whole else 0
    out = [f"tag {node.tag} links {links}", f"chars {min(node.chars.bit_length() // 2, 5)} links {links}", f"part {0 if part < 0.03 else 1 if part < 0.15 else 2 if part < 0.5 else 3}"]
    out += [f"word {w.rstrip('s') if len(w) > 3 else w}" for w in node.words]
    return out


@dataclass
class Model:
    """Log-potentials: of the root, of each feature (not content, content) and of each edge (parent, child)."""

    root: tuple[float, float]
    features: dict[str, tuple[float, float]]
    edges: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content, by one upward and one downward pass."""
        unary = []
        known = self.features.get
        for node in nodes:
            a = b = 0.0
            for f in evidence(node, nodes[0].below):
                if (w := known(f)) is not None:
                    a += w[0]
                    b += w[1]
            unary.append((a, b))
        (e00, e01), (e10, e11) = self.edges
        up0, up1 = [u[0] for u in unary], [u[1] for u in unary]
        sent = [(0.0, 0.0)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            x, y = up0[k], up1[k]
            m0, m1 = _add(e00 + x, e01 + y), _add(e10 + x, e11 + y)
            sent[k] = (m0, m1)
            up0[nodes[k].parent] += m0
            up1[nodes[k].parent] += m1
        down = [self.root] * len(nodes)
        out = [0.0] * len(nodes)
        for k, node in enumerate(nodes):
            if k:
                p = node.parent
                x, y = down[p][0] + up0[p] - sent[k][0], down[p][1] + up1[p] - sent[k][1]
                down[k] = (_add(e00 + x, e10 + y), _add(e01 + x, e11 + y))
            gap = down[k][1] + up1[k] - down[k][0] - up0[k]
            out[k] = 1 / (1 + math.exp(-max(min(gap, 500), -500)))
        return out


def _add(a: float, b: float) -> float:
    """Logarithm of the sum of two exponentials."""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def labels_of(nodes: list[Node]) -> list[int]:
    """A node's own label, else its parent's; the root is content."""
    out = [1]
    for node in nodes[1:]:
        out.append(out[node.parent] if node.label is None else node.label)
    return out


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Estimate the potentials from pages whose elements bear `data-label` (1 content, 0 not; inherited)."""
    edge, features, totals = Counter(), Counter(), Counter()
    for page in pages:
        nodes, _ = parse(page)
        labels = labels_of(nodes)
        for k, node in enumerate(nodes):
            totals[labels[k]] += 1
            for f in evidence(node, nodes[0].below):
                features[f, labels[k]] += 1
            if k:
                edge[labels[node.parent], labels[k]] += 1
    weights = {}
    for f in {f for f, _ in features}:
        # a feature's weight: how much likelier it is in each class, so that unseen ones weigh nothing
        weights[f] = tuple(math.log((features[f, y] + smooth) / (totals[y] + 2 * smooth)) for y in (0, 1))
    rows = [sum(edge[y, z] for z in (0, 1)) for y in (0, 1)]
    edges = tuple(tuple(math.log((edge[y, z] + smooth) / (rows[y] + 2 * smooth)) for z in (0, 1)) for y in (0, 1))
    return Model((math.log(0.05), math.log(0.95)), weights, edges)


def main_text(page: str | None, model: Model) -> str:
    """The text of a page's content nodes: blocks in page order, one line each."""
    if not page:
        return ""
    nodes, runs = parse(page, labelled=False)
    keep = [p >= 0.5 for p in model.marginals(nodes)]
    blocks: list[str] = []
    now, held = -1, []
    for own, block, value in runs:
        if keep[own]:
            if block != now:
                blocks.append("".join(held))
                now, held = block, []
            held.append(value)
    blocks.append("".join(held))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` of every page, in one narrow pass.

    `pages` has `page_id`, `url` and `html`; other columns are ignored. Null, empty and contentless pages give an empty
    text of 0 characters; broken markup is read as browsers do, as far as open elements go; pages are read whole, however
    deep their elements are nested. Repeated rows are extracted each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, sources in rows_of(batches, "html", 500):
            texts = [main_text(s, own) for s in sources]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
