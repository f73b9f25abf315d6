"""Main text of web pages by a minimum cut over their blocks."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import lowest_hashes

# Bounds of the sample the block classifier is trained on.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 200_000

# Elements that break a line, whose content is no text, that hold the
# article, that never do, and words of class and id names (split at signs) that mark
# what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title template noscript iframe noembed noframes svg math object select option datalist button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(["article", "main"])
BOILER = frozenset("nav footer aside form menu dialog search fieldset head".split())
CONTENT_ROLES = frozenset(["main", "article"])
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending comment comments respond reply replies discussion disqus widget toolbar pagination "
    "pager skip copyright legal disclaimer paywall".split()
)
# Only outside the article: an article has a header of its own.
HEADERS = frozenset(["header", "topbar"])
# An opening tag of the first kind closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead div section article main nav aside footer header form body".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=\s|/|$)""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall

FEATURES = 8


@dataclass
class Element:
    parent: int
    tag: str
    depth: int
    content: bool
    boiler: bool
    words: int = 0


@dataclass
class Block:
    text: str
    element: int
    linked: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element(-1, "", 0, False, False)])
    blocks: list[Block] = field(default_factory=list)


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element by its name and attributes holds the article, or what isn't it."""
    content, boiler = tag in CONTENT, tag in BOILER
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = {w.lower() for w in _SPLIT(value)}
                boiler |= not words.isdisjoint(BOILER_WORDS)
                if not words.isdisjoint(HEADERS):
                    boiler |= tag not in ("header", "h1", "h2", "h3")
            elif name == "role":
                content |= value.lower() in CONTENT_ROLES
                boiler |= value.lower() in BOILER_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                boiler = True
            elif name == "style":
                boiler |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return content and not boiler, boiler


def parse(html: str) -> Page:
    """Blocks of text in page order, each with the element it stands in.

    Unclosed and crossing tags are closed as browsers do in the common cases; a tag
    that the page's end cuts off is no text.
    """
    page = Page()
    elements, stack = page.elements, [0]
    text: list[str] = []
    linked = links = at = 0
    open_tags: Counter[str] = Counter()
    # For each element the innermost around it, itself included, that breaks lines.
    breaking = [0]

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                # The block's element: the innermost that breaks lines.
                page.blocks.append(Block(joined, breaking[stack[-1]], min(linked, len(joined))))
            text.clear()
        linked = 0

    def say(data: str) -> None:
        nonlocal linked
        data = unescape(data) if "&" in data else data
        text.append(data)
        if links:
            linked += len(data.strip())

    def close(index: int) -> None:
        nonlocal links
        for e in stack[index:]:
            links -= elements[e].tag == "a"
            open_tags[elements[e].tag] -= 1
        del stack[index:]

    def last(names, stop=frozenset()) -> int | None:
        if not any(open_tags[n] for n in names):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if elements[stack[i]].tag in names:
                return i
            if elements[stack[i]].tag in stop:
                return None
        return None

    # Searched anew after each tag: what a skipped element holds is never scanned.
    while (match := _TAG.search(html, at)) is not None:
        if match.start() > at:
            say(html[at: match.start()])
        at = match.end()
        slash, name, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if slash:
            index = last((tag,))
            if index is not None:
                close(index)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            # Nothing up to the closing tag is text.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCKS:
            open_ = last(("p",), LISTS)
            if open_ is not None:
                close(open_)
            if tag in CLOSES:
                open_ = last(CLOSES[tag], LISTS - {"div", "section"})
                if open_ is not None:
                    close(open_)
        content, boiler = _marks(tag, attributes)
        if tag == "header":
            boiler |= last(CONTENT) is None
        elements.append(Element(stack[-1], tag, len(stack), content, boiler))
        breaking.append(len(elements) - 1 if tag in BLOCKS else breaking[stack[-1]])
        stack.append(len(elements) - 1)
        open_tags[tag] += 1
        links += tag == "a"
    if at < len(html):
        say(html[at:])
    flush()
    return page


def containers(page: Page) -> list[int]:
    """For each block 1 inside the article, -1 inside something else, 0 where markup says nothing.

    A name such as "has-sidebar" on a wrapper of all articles, or of most words where
    there is no article, says nothing about what it wraps.
    """
    elements = page.elements
    for block in page.blocks:
        elements[block.element].words += block.text.count(" ") + 1
    # Elements stand in page order, so the parts of each come before its end.
    ends = list(range(len(elements)))
    for i in range(len(elements) - 1, 0, -1):
        parent = elements[i].parent
        elements[parent].words += elements[i].words
        ends[parent] = max(ends[parent], ends[i])
    articles = [i for i, e in enumerate(elements) if e.content and e.words]
    boiler = [e.boiler for e in elements]
    total = elements[0].words
    for i, e in enumerate(elements):
        if boiler[i] and e.tag not in BOILER:
            if articles:
                whole = i <= articles[0] and articles[-1] <= ends[i]
            else:
                whole = e.words > 0.6 * total
            boiler[i] = not whole
    kinds: list[int] = []
    for i, e in enumerate(elements):
        above = kinds[e.parent] if i else 0
        kinds.append(-1 if boiler[i] or above < 0 else 1 if e.content else above)
    return [kinds[b.element] for b in page.blocks]


def describe(page: Page) -> list[tuple[float, ...]]:
    """The features of each block."""
    out = []
    for block, container in zip(page.blocks, containers(page), strict=True):
        words = block.text.count(" ") + 1
        tag = page.elements[block.element].tag
        out.append((
            1.0, float(container), block.linked / len(block.text), min(1.0, math.log1p(words) / 5), float(block.text[-1] in ".!?…:;\"'”»)"),
            float(tag in ("p", "blockquote", "pre")), float(tag in ("li", "td", "th", "dt", "dd", "option")),
            float("©" in block.text or "rights reserved" in block.text.lower()),
        ))
    return out


@dataclass(frozen=True)
class Model:
    """Weights of the block classifier, and of the two kinds of smoothness edges."""

    weights: tuple[float, ...]
    adjacent: float = 0.6
    sibling: float = 0.4

    def costs(self, features: tuple[float, ...]) -> tuple[float, float]:
        """What calling the block boilerplate costs, and calling it content."""
        z = max(-9.0, min(9.0, sum(w * f for w, f in zip(self.weights, features, strict=True))))
        return math.log1p(math.exp(z)), math.log1p(math.exp(-z))


# Used where no page of the sample has marked blocks of both kinds.
PLAIN = Model((-1.5, 6.0, -4.0, 4.0, 1.0, 0.5, -1.0, -2.0))


def fit(pages: list[str]) -> Model:
    """Logistic weights from blocks whose elements say what they are.

    Each block is shown twice, the second time without what its elements say, so
    that pages without such elements are judged by their text.
    """
    rows = [f for html in pages for f in describe(parse(html)) if f[1]]
    if not rows:
        return PLAIN
    marked = np.array(rows)
    y = (marked[:, 1] > 0).astype(float)
    if y.min() == y.max():
        return PLAIN
    bare = marked.copy()
    bare[:, 1] = 0
    x, y = np.concatenate([marked, bare]), np.concatenate([y, y])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    theta = np.zeros(FEATURES)
    pull = np.diag([1e-4, *[1e-3] * (FEATURES - 1)]) * len(y)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (p - y)) + pull @ theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    # What the elements say outweighs all text features together.
    theta[1] = max(theta[1], 3 + np.abs(theta[2:]).sum())
    return Model(tuple(float(t) for t in theta))


def minimum_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source when the cheapest set of edges is cut (max-flow, by shortest augmenting levels)."""
    n = len(to_source)
    graph: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, capacity in edges:
        graph[a].append(len(head))
        graph[b].append(len(head) + 1)
        head += [b, a]
        room += [capacity, capacity]
    # Each node's own path first: what is left leads to one terminal only.
    supply = [max(0.0, s - t) for s, t in zip(to_source, to_sink, strict=True)]
    demand = [max(0.0, t - s) for s, t in zip(to_source, to_sink, strict=True)]
    least = 1e-12
    while True:
        level = [0 if s > least else -1 for s in supply]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached |= demand[i] > least
            for e in graph[i]:
                if room[e] > least and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while level[start] == 0 and supply[start] > least:
                path, i = [], start
                while not demand[i] > least:
                    while turn[i] < len(graph[i]):
                        e = graph[i][turn[i]]
                        if room[e] > least and level[head[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            break
                        i = head[path.pop() ^ 1]
                        turn[i] += 1
                        continue
                    path.append(e)
                    i = head[e]
                if not demand[i] > least:
                    break
                pushed = min([supply[start], demand[i], *(room[e] for e in path)])
                supply[start] -= pushed
                demand[i] -= pushed
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed


def smoothness(page: Page, model: Model) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the text, weaker the further apart in the tree, and between siblings."""
    elements, blocks = page.elements, page.blocks
    edges, before = [], {}
    for i, block in enumerate(blocks):
        if i:
            a, b, steps = blocks[i - 1].element, block.element, 0
            while a != b:
                if elements[a].depth >= elements[b].depth:
                    a = elements[a].parent
                else:
                    b = elements[b].parent
                steps += 1
            edges.append((i - 1, i, model.adjacent / (1 + steps / 2)))
        parent = elements[block.element].parent
        if parent in before:
            edges.append((before[parent], i, model.sibling))
        before[parent] = i
    return edges


def main_text(html: str, model: Model) -> str:
    """The blocks on the content side of the cut, joined by line breaks."""
    page = parse(html)
    if not page.blocks:
        return ""
    costs = [model.costs(f) for f in describe(page)]
    kept = minimum_cut([c[0] for c in costs], [c[1] for c in costs], smoothness(page, model))
    return "\n".join(block.text for block, keep in zip(page.blocks, kept, strict=True) if keep)


def _extract(model: Model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, model) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    return extract


def train(pages: DataFrame, html_col: str = "html") -> Model:
    """A block classifier from a bounded sample of different pages, picked by their hash."""
    short = pages.filter(F.octet_length(html_col) <= SAMPLE_BYTES).select(F.col(html_col).alias("html"))
    picked = short.filter(lowest_hashes(short, F.col("html"), SAMPLE_PAGES)).distinct()
    return fit(sorted(r["html"] for r in picked.collect()))


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every whole page.

    A page is parsed into blocks; a trained classifier's costs are the capacities to
    the two terminals, neighbours in the text and siblings in the tree are joined by
    edges, and the minimum cut parts the article from the rest.

    Returns id, url, text, n_chars for every row.  A null or empty page, or one
    without text, gives an empty text.  An empty table gives no rows; other columns are
    neither read nor returned.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInArrow(_extract(model), f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
