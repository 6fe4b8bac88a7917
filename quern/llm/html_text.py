"""Main text of HTML pages by a minimum cut over their blocks.

A page is read into blocks of text, each with the elements it stands in. A classifier gives every
block a cost for either label; these are the capacities of its edges to the two terminals. Blocks
that follow each other, and blocks that share their container, are joined by smoothness edges, the
stronger the nearer they are in the DOM. The minimum cut separates content from boilerplate.

Before the max-flow, blocks whose terminal edge outweighs all their smoothness edges are settled:
such a block has that label in every minimum cut. Only the rest is left to augmenting paths.
"""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# HTML's own element classes.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "meter", "output", "picture", "progress", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input",
}
CONTENT = {"article": 3, "main": 2}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head", "fieldset", "datalist", "optgroup"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words of class, id and role that name boilerplate (whole words, or beginnings of words), that do so
#: even on an article, and that name content.
_WORD, _END = r"(?:^|[\s_-])", r"(?:$|[\s_-])"
BAD_NAME = re.compile(
    rf"{_WORD}(?:(?:ad|ads|gdpr|alert|side|search|legal|skip|login|signup|respond|pager|dialog|complementary|contentinfo){_END}|"
    r"(?:advert|adsense|adslot|adbox|adsby|banner|sponsor|promo|cookie|consent|notice|popup|modal|overlay|comment|disqus|repl(?:y|ies)|sidebar|widget|related|recommend|share|sharing|"
    r"social|newsletter|subscri|menu|nav|breadcrumb|paginat|footer|header|masthead|copyright|toolbar))"
)
BAD_ARTICLE = re.compile(rf"{_WORD}(?:(?:ad|ads){_END}|(?:advert|sponsor|promo|comment|repl(?:y|ies)|related|recommend|teaser|widget))")
GOOD_NAME = re.compile(rf"{_WORD}(?:article|content|main|post|entry|story|body|text){_END}")

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_space = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    """An open element. inside: 3 in an article, 2 in the main part, 1 in what is named as content, -1 in
    boilerplate, 0 in none of them. Nothing inside boilerplate is content."""

    name: str
    number: int
    inside: int
    link: bool


@dataclass(slots=True)
class Block:
    """Text between two block boundaries; container: the nearest block-level element's number."""

    text: str
    container: int
    parent: int
    inside: int
    linked: int
    heading: bool


def _kind(name: str, attributes: str, outer: int) -> int:
    if outer < 0 or name in BOILERPLATE:
        return -1
    own = CONTENT.get(name, 0)
    if attributes and name not in ("html", "body"):
        if _hidden.search(attributes):
            return -1
        names = " ".join(a or b or c for a, b, c in _named.findall(attributes)).lower()
        if names:
            if (BAD_ARTICLE if name == "article" else BAD_NAME).search(names) and name != "main":
                return -1
            own = own or int(bool(GOOD_NAME.search(names)))
    return max(own, outer)


def read_blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Scripts, styles, comments and other raw elements give none."""
    blocks: list[Block] = []
    stack = [Element("", 0, 0, False)]
    numbers = linked = 0
    parts: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _space.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                own = [e for e in stack if e.name not in INLINE]
                blocks.append(Block(text, own[-1].number, own[-2].number if len(own) > 1 else 0, stack[-1].inside if stack[-1].inside < 0 else own[-1].inside, min(linked, len(text)), own[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6")))
            parts.clear()
        linked = 0

    while at < end:
        m = _token.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if stack[-1].link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closes, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        inline = name in INLINE
        if not inline:
            flush()
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if inline and stack[-1].inside != stack[i - 1].inside:
                        flush()
                    del stack[i:]
                    break
                if inline and stack[i].name not in INLINE:
                    break
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*(?:>|/|\Z)", re.I).search(page, at)
                at = close.start() if close else end
            continue
        if name in ENDS_P and stack[-1].name != "p":
            open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name not in INLINE), 0)
            if stack[open_p].name == "p":
                del stack[open_p:]
        elif name in ENDS_P and stack[-1].name == "p":
            stack.pop()
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
            stack.pop()
        if name in VOID:
            continue
        numbers += 1
        inside = _kind(name, attributes, stack[-1].inside)
        if inline and inside != stack[-1].inside:
            flush()
        if not (inline and attributes.endswith("/")):
            stack.append(Element(name, numbers, inside, stack[-1].link or name == "a"))
    flush()
    return blocks


def block_cost(block: Block, best: int) -> float:
    """Log odds that a block is content. What it stands in counts most (best: the most that any block of
    the page stands in); then its length, and how much of it is links."""
    if block.inside < 0:
        return -8.0
    words = block.text.count(" ") + 1
    odds = -0.5 if best <= 0 else 6.0 if block.inside >= best else -6.0
    odds += min(words, 40) / 20 - 4.0 * (block.linked / max(1, len(block.text)))
    return odds + 0.5 * block.heading


def min_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of a minimum cut: node i pays terminal[i] if it is not on the source's side (positive), or
    -terminal[i] if it is (negative); each edge pays its weight if cut. Of several minimum cuts, that
    with the fewest nodes on the source's side, except nodes with no cost either way."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    cost = list(terminal)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _augment(rest, cost, near, label)
    return [bool(x) for x in label]


def _augment(rest: list[int], cost: list[float], near: list[dict[int, float]], label: list[bool | None]) -> None:
    """Shortest augmenting paths over what is left undecided; the source's side is what it still reaches."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {source: {}, sink: {}, **{i: dict(near[i]) for i in rest}}
    for i in rest:
        if cost[i] > 0:
            left[source][i], left[i][source] = cost[i], 0.0
        elif cost[i] < 0:
            left[i][sink], left[sink][i] = -cost[i], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in left[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            break
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(left[i][j] for i, j in path)
        for i, j in path:
            left[i][j] -= flow
            left[j][i] = left[j].get(i, 0.0) + flow
    for i in rest:
        label[i] = i in came


def main_text(page: str | None) -> str:
    """The page's content blocks in order, joined by one space; empty if there are none.

    Null and empty pages give an empty text. Character references are decoded, white space inside a
    block becomes one space, and nothing else is dropped or cut. Unclosed tags end with their parent;
    an unclosed comment, script or tag runs to the page's end.
    """
    if not page:
        return ""
    blocks = read_blocks(page)
    best = max([b.inside for b in blocks], default=0)
    last: dict[int, int] = {}
    edges: dict[tuple[int, int], float] = {}
    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            near = before.container == b.container or before.parent == b.parent
            edges[i - 1, i] = 1.0 if near else 0.25
        for key in {b.container, b.parent}:
            if key in last and last[key] < i - 1:
                edges[last[key], i] = edges.get((last[key], i), 0.0) + 0.5
            last[key] = i
    label = min_cut([block_cost(b, best) for b in blocks], edges)
    return " ".join([b.text for b, keep in zip(blocks, label, strict=True) if keep])


def _texts(batches: Iterator[pa.RecordBatch], schema: pa.Schema, n_keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(n_keep)]
        yield pa.record_batch([*batch.columns[:n_keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """`keep` columns, text, n_chars of every row of `pages`; one pass, no shuffle. Rows that repeat are
    each answered; other columns are not read."""
    schema = T.StructType([pages.schema[c] for c in keep]).add("text", T.StringType()).add("n_chars", T.LongType())
    return pages.select(*keep, F.col(html_column)).mapInArrow(functools.partial(_texts, schema=to_arrow_schema(schema), n_keep=len(keep)), schema)
