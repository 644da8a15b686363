"""Main-text extraction by minimum cut (list item 10).

A page becomes a list of text blocks, each with what encloses it.  A logistic
classifier gives each block the cost of calling it content and of calling it
boilerplate; these are the capacities of its edges to the two terminals.
Edges between neighbouring blocks, stronger the closer they are in the
document tree, make it costly to cut through a run of blocks.  The minimum
cut labels the blocks of a page at once.

Terminal capacities have two parts of about equal size: the classifier's
log-odds, from what a block's text and layout look like, and evidence from
what encloses it (article, main; nav, footer, aside, names such as "sidebar").
Links are of that size too, so a block that looks unlike its neighbours is
decided by the flow, not by its own sign.  A name or a form around the whole
page says nothing about it and is not evidence.

The classifier is trained without labels by hand: blocks whose enclosing
elements say what they are serve as examples, from at most ``MAX_PAGES`` pages;
those elements themselves are held out of its features.  Its weights are drawn
towards stated priors, which alone decide where a corpus has no such examples.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MAX_PAGES = 400

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKENS = re.compile(r"[a-z0-9]+")

#: HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table div article section main body".split())
_DROPPED = frozenset("head button select option dialog menu".split())

#: Names that sites give to what encloses content or boilerplate.
_BAD = frozenset("ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget comment comments disqus reply replies respond toolbar pagination pager skip adsbygoogle adslot adunit rail topbar discussion responses feedback sitemap teaser".split())
#: Parts of names that say that something is there or how it is, not that this is it.
_STATES = frozenset("has with no without is open closed enabled disabled off on".split())
_GOOD = frozenset("article content post entry story body main text".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())

ARTICLE, MAIN, NAV, HEADER, FOOTER, ASIDE, BAD, GOOD, FORM, DROP = (1 << k for k in range(10))
_AWAY = NAV | HEADER | FOOTER | ASIDE | BAD
_MARKS = {"article": ARTICLE, "main": MAIN, "nav": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE, "form": FORM, "fieldset": FORM}

#: Log-odds for content that an enclosing element adds.
EVIDENCE = {ARTICLE: 2.0, MAIN: 1.5, GOOD: 0.5, NAV: -4.0, HEADER: -3.0, FOOTER: -4.0, ASIDE: -4.0, BAD: -3.0}
FEATURES = ("bias", "link_share", "long", "short", "sentence", "heading", "item", "paragraph", "commas")
PRIOR = np.array([-0.5, -3.0, 2.0, -0.7, 1.0, 0.3, -0.7, 0.7, 0.5])
#: The classifier's log-odds are cut off here: text alone is never surer than that.
SURE = 2.0


class Block:
    """text, how many of its characters are in links, marks, the element that holds it and that element's name."""

    __slots__ = ("text", "linked", "marks", "tag", "element")

    def __init__(self, text: str, linked: int, tag: str, element: int):
        self.text, self.linked, self.marks, self.tag, self.element = text, linked, 0, tag, element


class Page:
    """The text blocks of a page, in order, without scripts, styles, comments, forms and markup.

    parent and depth are of its block elements, numbered in page order from
    the root 0.  Time is linear in the length of the page, whatever is left
    open in it.
    """

    def __init__(self, page: str):
        self.parent, self.depth, self.own = [-1], [0], [0]
        self.blocks: list[Block] = []
        self._read(page)
        self._mark()

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # name, nearest block element
        opened: dict[str, list[int]] = {}  # name -> its places in the stack
        in_blocks: list[int] = []  # the places of block elements in the stack
        texts: list[str] = []
        linked, in_link, at, end = 0, 0, 0, len(page)
        missing: set[str] = set()  # what does not occur in the rest of the page

        def find(what: str, start: int) -> int:
            if what in missing:
                return -1
            found = page.find(what, start)
            if found < 0:
                missing.add(what)
            return found

        def tag_end(start: int) -> int:
            """The place of the > that ends a tag, -1: none."""
            place = start
            while m := _QUOTE_OR_END.search(page, place):
                if m[0] == ">":
                    return m.start()
                close = find(m[0], m.end())
                place = close + 1 if close >= 0 else m.end()
            return -1

        def flush() -> None:
            nonlocal linked
            if texts:
                words = entities.unescape("".join(texts)).split()
                if words:
                    element = stack[-1][1] if stack else 0
                    self.blocks.append(Block(" ".join(words), linked, self.names[element], element))
                texts.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal in_link
            for name, _ in stack[to:]:
                opened[name].pop()
                in_link -= name == "a"
            del stack[to:]
            while in_blocks and in_blocks[-1] >= to:
                in_blocks.pop()

        def last(names) -> int:
            return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

        self.names = [""]
        while at < end:
            start = find("<", at)
            text = page[at : start if start >= 0 else end]
            if text:
                texts.append(text)
                linked += len(text) * (in_link > 0)
            if start < 0:
                break
            closing = page.startswith("/", start + 1)
            m = _NAME.match(page, start + 1 + closing)
            if not m:
                if page.startswith("<!--", start):
                    close = find("-->", start + 4)
                    at = close + 3 if close >= 0 else end
                    continue
                if page.startswith("<![CDATA[", start) and (close := find("]]>", start)) >= 0:
                    texts.append(entities.escape(page[start + 9 : close]))
                    at = close + 3
                    continue
                close = find(">", start) if page.startswith(("!", "?"), start + 1) else -1
                if close < 0:
                    texts.append("<")
                at = close + 1 if close >= 0 else start + 1
                continue
            close = -1 if ">" in missing else tag_end(m.end())
            if close < 0:  # a tag that never ends is text
                missing.add(">")
                texts.append("<")
                at = start + 1
                continue
            at, tag, attributes = close + 1, m[0].lower(), page[m.end() : close]
            if closing:
                if tag not in _INLINE:
                    flush()
                elif tag == "br":
                    texts.append(" ")
                if opened.get(tag) and (tag not in _INLINE or opened[tag][-1] > (in_blocks[-1] if in_blocks else -1)):
                    pop(opened[tag][-1])
                continue
            alone = attributes.endswith("/")
            if tag in _RAW:
                if not alone:
                    close = end if f"</{tag}" in missing else self._raw_end(page, tag, at)
                    if close == end:
                        missing.add(f"</{tag}")
                    at = close
                if tag not in ("svg", "math", "object", "canvas", "script", "noscript", "template"):
                    flush()
                continue
            if tag not in _INLINE:
                flush()
                k = last(_CLOSES.get(tag, ("p",)))
                if k > last(_STOPS):
                    pop(k)
            elif tag == "br":
                texts.append(" ")
            if tag in _VOID or alone:
                continue
            element = stack[-1][1] if stack else 0
            if tag not in _INLINE:
                self.parent.append(element)
                self.depth.append(self.depth[element] + 1)
                self.own.append(_own_marks(tag, attributes))
                self.names.append(tag)
                element = len(self.parent) - 1
                in_blocks.append(len(stack))
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, element))
            in_link += tag == "a"
        flush()

    @staticmethod
    def _raw_end(page: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        return m.end() if m else len(page)

    def _mark(self) -> None:
        n = len(self.parent)
        size, first = [0] * n, next((e for e in range(n) if self.own[e] & (ARTICLE | MAIN)), -1)
        for b in self.blocks:
            size[b.element] += len(b.text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        around = set()  # the elements around the first article
        e = first
        while e > 0:
            e = self.parent[e]
            around.add(e)
        marks = [self.own[0]] * n
        for e in range(1, n):
            own, above = self.own[e], marks[self.parent[e]]
            if e in around or first < 0 and 2 * size[e] > size[0]:
                own &= ~(BAD | FORM)
            if above & (ARTICLE | MAIN):
                own &= ~HEADER
            marks[e] = above | own
        for b in self.blocks:
            b.marks = marks[b.element]
        self.blocks = [b for b in self.blocks if not b.marks & (DROP | FORM)]


def _own_marks(tag: str, attributes: str) -> int:
    """What an element says about itself."""
    own = _MARKS.get(tag, 0) | DROP * (tag in _DROPPED)
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and tag not in ("html", "body"):
            for one in value.split():
                parts = set(_TOKENS.findall(one))
                if parts & _BAD and not parts & _STATES and tag not in ("article", "main"):
                    own |= BAD
                if "header" in parts:
                    own |= HEADER
                if parts & _GOOD:
                    own |= GOOD
        elif name == "role":
            own |= BAD * (value in _BAD_ROLES) | ARTICLE * (value == "article") | MAIN * (value == "main")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            own |= DROP
    return own


def features(found: list[Block]) -> np.ndarray:
    """What the text and the layout of blocks look like; what encloses them is held out."""
    x = np.zeros((len(found), len(FEATURES)))
    for k, b in enumerate(found):
        n = b.text.count(" ") + 1
        x[k] = (1, min(1.0, b.linked / max(1, len(b.text))), min(1.0, n / 30), n < 4, b.text[-1] in ".!?:;\"')", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag == "li", b.tag == "p", min(1.0, 10 * b.text.count(",") / n))
    return x


def evidence(found: list[Block]) -> np.ndarray:
    """Log-odds from the enclosing elements; what is set apart inside an article is not the article."""
    return np.array([sum(w for mark, w in EVIDENCE.items() if b.marks & mark and (w < 0 or not b.marks & _AWAY)) for b in found])


def weak_label(b: Block) -> int:
    """1 content, 0 boilerplate, -1 not known: by what the enclosing elements say."""
    if b.marks & _AWAY:
        return 0
    return 1 if b.marks & (ARTICLE | MAIN) else -1


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 30.0) -> np.ndarray:
    """Logistic regression by Newton steps, with weights drawn to PRIOR by pull."""
    w = PRIOR.copy()
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (w - PRIOR)
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
    return w


def edges(page: Page, near: float = 3.0, far: float = 0.3) -> list[tuple[int, int, float]]:
    """Neighbours in the page, the stronger the closer in the tree, and each block with the last one before it under the same element."""
    out, last, parent, depth = {}, {}, page.parent, page.depth
    for k, b in enumerate(page.blocks):
        if k:
            x, y, apart = page.blocks[k - 1].element, b.element, 0
            while x != y:  # up to where they meet: as many steps as the page has tags between them
                if depth[x] >= depth[y]:
                    x = parent[x]
                else:
                    y = parent[y]
                apart += 1
            # The edge of an element that sets itself apart is no place for smoothing.
            split = (page.blocks[k - 1].marks ^ b.marks) & _AWAY
            out[k - 1, k] = far if split else far + (near - far) / (1 + max(0, apart - 2))
        for element in {b.element, max(parent[b.element], 0)}:
            j = last.get(element)
            if j is not None and j != k - 1 and j != k:
                out[j, k] = out.get((j, k), 0) + far
            last[element] = k
    return [(i, j, c) for (i, j), c in out.items()]


_LITTLE = 1e-12


def source_side(supply: dict[int, float], demand: dict[int, float], flow: list[dict[int, float]]) -> set[int]:
    """The nodes on the side of the supplies in the smallest minimum cut, by blocking flows on levels; all three are used up."""
    while True:
        level = {i: 0 for i, s in supply.items() if s > _LITTLE}
        todo, met = deque(level), False
        while todo:
            i = todo.popleft()
            met = met or demand.get(i, 0) > _LITTLE
            for j, c in flow[i].items():
                if c > _LITTLE and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if not met:
            return set(level)
        ways = {i: iter(list(flow[i])) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and supply[start] > _LITTLE:
                i = path[-1]
                if demand.get(i, 0) > _LITTLE:
                    steps = list(zip(path, path[1:], strict=False))
                    push = min([supply[start], demand[i], *(flow[a][b] for a, b in steps)])
                    supply[start] -= push
                    demand[i] -= push
                    full = len(path)
                    for k, (a, b) in enumerate(steps):
                        flow[a][b] -= push
                        flow[b][a] += push
                        if flow[a][b] <= _LITTLE:
                            full = min(full, k + 1)
                    del path[full:]  # back to before the first edge that is used up
                    continue
                for j in ways[i]:
                    if flow[i][j] > _LITTLE and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def minimum_cut(gain: np.ndarray, links: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) that minimise the sum of -gain over content and of the cut links.

    gain: cost as boilerplate less cost as content.  A block whose gain
    outweighs all its links keeps its sign in every minimum cut, so such
    blocks are settled first; max-flow decides among the others.
    """
    n = len(gain)
    own, label = gain.astype(float).copy(), np.zeros(n, np.int8)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        around[i][j] = around[i].get(j, 0) + c
        around[j][i] = around[j].get(i, 0) + c
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if not label[i] and abs(own[i]) > sum(around[i].values()):
            label[i] = 1 if own[i] > 0 else -1
            for j, c in around[i].items():
                del around[j][i]
                own[j] += c * label[i]
                queue.append(j)
            around[i] = {}
    rest = [i for i in range(n) if not label[i]]
    if rest:
        flow = [dict(a) for a in around]
        for i in rest:
            for j in flow[i]:
                flow[j].setdefault(i, 0.0)
        seen = source_side({i: own[i] for i in rest if own[i] > 0}, {i: -own[i] for i in rest if own[i] < 0}, flow)
        for i in rest:
            label[i] = 1 if i in seen else -1
    return label > 0


def gains(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Cost as boilerplate less cost as content of each block."""
    return np.clip(features(found) @ weights, -SURE, SURE) + evidence(found)


def main_text(html: str, weights: np.ndarray) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    keep = minimum_cut(gains(page.blocks, weights), edges(page))
    return "\n".join(b.text for b, k in zip(page.blocks, keep, strict=True) if k)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> np.ndarray:
    """Weights of the block classifier, from the max_pages pages with the smallest hashes of their ids."""
    ids = pages.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id")).limit(max_pages).distinct()
    picked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                found = Page(page or "").blocks
                rows += [(weak_label(b), x) for b, x in zip(found, features(found).tolist(), strict=True) if weak_label(b) >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])

    # Equal rows are counted, so what comes here is small.
    rows = picked.mapInArrow(run, "y int, x array<double>").groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return PRIOR
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return train(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float))


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, text (blocks joined by newlines) and n_chars of every page.

    A null or empty page, or one without content, gives an empty text.  Null
    ids are kept, rows that repeat are extracted each, and an empty table
    gives an empty one.  Long pages are read whole, in linear time.  Where two
    cuts cost the same, the block is boilerplate.
    """
    schema = T.StructType([pages.schema[id_col], *(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", weights) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, *keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), keep=("url",))
