"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree.  Each has a potential from its tag, names,
links and lengths; each parent-child pair has one for agreeing or not.
Sum-product messages up and down the tree give the exact probability that an
element's own text is content.  The potentials are trained on labelled pages.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.labelled import sigmoid
from pagequarry.llm.page_samples import labelled_pages
from pagequarry.llm.shared import ship
from pagequarry.llm.tokens import sliced

# HTML's elements by kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never shown as text.
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas select textarea button audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Any other opening tag ends an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
#: An opening tag ends an open element of these, as HTML lets authors leave out end tags.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# Words in class, id and role that tell what an element is for.
NAMES = (
    "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc".split(),
    "header masthead banner topbar logo".split(),
    "footer contentinfo copyright colophon".split(),
    "sidebar aside complementary widget column rail".split(),
    "ad ads advert advertisement adverts sponsor sponsored promo promoted promotion adsense outbrain taboola".split(),
    "cookie cookies consent notice alert popup modal overlay gdpr warning dialog announcement".split(),
    "form newsletter subscribe subscription login signup register search contact".split(),
    "comment comments reply replies response responses disqus discussion respond".split(),
    "related recommended share social sharing tags tag meta byline popular trending".split(),
    "content article story post entry body text main".split(),
)
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre nav header footer aside form figure figcaption dl dt dd body html fieldset address details menu".split()
#: Without names, these take part in what they stand in; other elements may begin or end content.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li tr td th dt dd tbody thead table ul ol dl blockquote pre figure figcaption hr".split())
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
_NAME_NUMBER = {w: i for i, words in enumerate(NAMES) for w in words}
N_FEATURES = len(TAGS) + 1 + len(NAMES) + 8

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>", re.S
)
_OPEN_END = re.compile(r"<[!?]")
_NAMES_OF = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Page:
    """Block elements in page order: tag, names, parent, depth; and text runs (element, text, in a link)."""

    tags: list[str] = field(default_factory=list)
    names: list[tuple[int, ...]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    runs: list[tuple[int, list[str]]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    states: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """A tolerant reading: missing end tags, stray ones and broken markup are fine."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements; inline ones have the number of their block

    def block(tag: str, attributes: str) -> int:
        names = set()
        for _, value in _NAMES_OF.findall(attributes) if attributes else ():
            names.update(_NAME_NUMBER[w] for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()) if w in _NAME_NUMBER)
        page.tags.append(tag)
        page.names.append(tuple(names))
        page.parents.append(stack[-1][1] if stack else -1)
        page.chars.append(0)
        page.link_chars.append(0)
        page.states.append(int(keep))
        return len(page.tags) - 1

    links = keep = hidden = 0  # open elements of each sort
    opened: Counter[str] = Counter()  # and of each tag, so that a stray end tag costs no look at the stack

    def push(tag: str, at: int) -> None:
        stack.append((tag, at))
        opened[tag] += 1

    push("", block("html", ""))
    fresh = True  # the next text starts a new run

    def text(raw: str) -> None:
        nonlocal fresh
        if hidden and stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if hidden or not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        at = stack[-1][1]
        if fresh or not page.runs or page.runs[-1][0] != at:
            page.runs.append((at, []))
            fresh = False
        page.runs[-1][1].append(value)
        n = len(value.strip())
        page.chars[at] += n
        page.link_chars[at] += n if links else 0

    def close(to: int) -> None:
        nonlocal links, fresh, hidden
        for tag, _ in stack[to:]:
            opened[tag] -= 1
            links -= tag == "a"
            hidden -= tag in HIDDEN
            fresh = fresh or tag not in INLINE
        del stack[to:]

    def end(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                close(i)
                return
            if stack[i][0] in scope:
                return

    last: dict[str, int] = {}

    def ends_later(tag: str, at: int) -> bool:
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", source, re.I)), default=-1)
        return last[tag] >= at

    at, lowered = 0, None
    # behind the last ``>`` there is no tag: looking for one at each ``<`` would read the rest again and again
    last_end = source.rfind(">") + 1
    found = _MARKUP.search(source, 0, last_end)
    while found:
        text(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        alone = bool(tag) and found[3].rstrip().endswith("/")
        if hidden and tag and not found[1] and (tag == "body" or stack[-1][0] == "head" and tag not in IN_HEAD):
            end(("head",), ())
        if not tag:
            pass
        elif tag == "keep-text":
            keep = not found[1]
            if keep:
                page.states[stack[-1][1]] = 1
        elif found[1]:
            end((tag,), ())
        elif tag == "br":
            text(" ")
        elif tag == "head":
            if stack[-1][0] in ("", "html"):
                push(tag, stack[-1][1])
                hidden += 1
        elif tag in HIDDEN:
            fresh = fresh or tag not in INLINE
            if tag in ("button", "select"):  # do not nest
                end((tag,), ())
            if tag in RAW and not (alone and any(t in ("svg", "math") for t, _ in stack)):  # ends at its own end tag, whatever is inside
                lowered = source.lower() if lowered is None else lowered
                stop = lowered.find(f"</{tag}", at)
                if stop < 0 or len(lowered) != len(source):
                    again = re.compile(f"</{tag}", re.I).search(source, at)
                    stop = again.start() if again else len(source)
                close_at = source.find(">", stop)
                at = close_at + 1 if 0 <= close_at else len(source)
            elif not alone and ends_later(tag, at):  # ends with its parent at the latest
                push(tag, stack[-1][1])
                hidden += 1
        elif tag in VOID:
            fresh = fresh or tag not in INLINE
        elif hidden and alone:
            pass
        elif hidden or tag in INLINE:
            push(tag, stack[-1][1])
            links += tag == "a"
        else:
            if tag in ENDS_PARAGRAPH:
                end(("p",), ("td", "th", "li", "div", "article", "section", "table", "button"))
            if tag in ENDS:
                end(ENDS[tag], SCOPES[tag])
            if tag not in ("html", "body") or not opened[tag]:
                fresh = True
                push(tag, block(tag, found[3]))
        found = _MARKUP.search(source, at, last_end)
    rest = source[at:]
    odd = _OPEN_END.search(rest)
    text(rest[: odd.start()] if odd else rest)
    return page


@dataclass
class Forest:
    """The trees of many pages: elements by number, parents before children."""

    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    first: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.tags) for p in pages]
    first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parents) + (np.array(p.parents) >= 0) * f for p, f in zip(pages, first)]) if pages else np.zeros(0, np.int64)
    depth = np.zeros(n, dtype=np.int64)
    for i, p in enumerate(parent.tolist()):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)] if n < 1 else _by_level(depth)
    own = np.array([c for p in pages for c in p.chars], dtype=float)
    links = np.array([c for p in pages for c in p.link_chars], dtype=float)
    total, total_links, below = own.copy(), links.copy(), np.ones(n)
    for at in levels[:0:-1]:
        np.add.at(total, parent[at], total[at])
        np.add.at(total_links, parent[at], total_links[at])
        np.add.at(below, parent[at], below[at])
    x = np.zeros((n, N_FEATURES))
    x[np.arange(n), [_TAG_NUMBER.get(t, len(TAGS)) for p in pages for t in p.tags]] = 1
    rows = [(f + i, w) for p, f in zip(pages, first) for i, names in enumerate(p.names) for w in names]
    if rows:
        r = np.array(rows)
        x[r[:, 0], len(TAGS) + 1 + r[:, 1]] = 1
    page_total = np.repeat(total[first[:-1]] if n else np.zeros(0), sizes)
    density = total_links / np.maximum(total, 1)
    x[:, -8:] = np.c_[
        density, density > 0.6, np.log1p(own) / 5, np.log1p(total) / 8, total / np.maximum(page_total, 1), own > 80, np.log1p(total / below) / 5, np.ones(n),
    ]
    kind = np.array([int(t in PLAIN and not names) for p in pages for t, names in zip(p.tags, p.names)], dtype=np.int64)
    return Forest(x, parent, kind, levels, first)


def _by_level(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def marginals(logit: np.ndarray, pair: np.ndarray, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each element and expected states (parent, child) of each edge, by sum-product.

    ``pair[k, a, b]`` is the log potential of a parent in state a and a child of kind k in b.
    """
    n, parent = len(logit), trees.parent
    unary = np.c_[np.zeros(n), logit]
    up = np.zeros((n, 2))  # message of a child to its parent
    inner = unary.copy()  # own potential and the children's messages
    for at in trees.levels[:0:-1]:
        joint = inner[at][:, None, :] + pair[trees.kind[at]]
        top = joint.max(2, keepdims=True)
        up[at] = (top + np.log(np.exp(joint - top).sum(2, keepdims=True)))[:, :, 0]
        np.add.at(inner, parent[at], up[at])
    down = np.zeros((n, 2))  # message of the parent to its child
    edges = np.zeros((n, 2, 2))
    for at in trees.levels[1:]:
        rest = inner[parent[at]] + down[parent[at]] - up[at]
        passed = rest[:, :, None] + pair[trees.kind[at]]
        joint = passed + inner[at][:, None, :]
        shape = np.exp(joint - joint.max((1, 2), keepdims=True))
        edges[at] = shape / shape.sum((1, 2), keepdims=True)
        top = passed.max(1, keepdims=True)
        message = (top + np.log(np.exp(passed - top).sum(1, keepdims=True)))[:, 0, :]
        down[at] = message - message.max(1, keepdims=True)
    belief = inner + down
    return sigmoid(belief[:, 1] - belief[:, 0]), edges


@dataclass
class TreeModel:
    unary: np.ndarray
    pair: np.ndarray

    def content(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        trees = forest(pages)
        return marginals(trees.x @ self.unary, self.pair, trees)[0], trees.first

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        p, first = self.content(pages)
        out = []
        for page, f in zip(pages, first):
            blocks = (" ".join("".join(parts).split()) for at, parts in page.runs if p[f + at] > 0.5)
            out.append(" ".join(b for b in blocks if b))
        return out


def fit(pages: list[str], steps: int = 400) -> TreeModel:
    """Potentials that maximise the likelihood of the pages' labels.

    Content are the elements that ``keep-text`` encloses and the one it stands in.
    """
    parsed = [parse(s) for s in pages]
    trees = forest(parsed)
    state = np.array([c for p in parsed for c in p.states], dtype=float)
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (trees.kind[child], state[trees.parent[child]].astype(int), state[child].astype(int)), 1)
    unary, pair = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    moments = [np.zeros(N_FEATURES + 8), np.zeros(N_FEATURES + 8)]
    for t in range(1, steps + 1):
        p, edges = marginals(trees.x @ unary, pair, trees)
        expected = np.stack([edges[child][trees.kind[child] == k].sum(0) for k in (0, 1)])
        slope = np.r_[(state - p) @ trees.x, (seen - expected).ravel()] / len(state) - 3e-5 * np.r_[unary, pair.ravel()]
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        change = 0.15 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
        unary, pair = unary + change[:-8], pair + change[-8:].reshape(2, 2, 2)
    return TreeModel(unary, pair)


@functools.cache
def default_model() -> TreeModel:
    return fit(labelled_pages())


def main_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, from the whole html.

    A null or empty html, or one without content, has an empty text.  Null and
    repeated ids are treated like others; an empty table gives no rows; other
    columns are ignored.  No row is moved.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())  # under a hundred numbers
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", 4 << 20):
            texts = shared.value.texts([s or "" for s in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
