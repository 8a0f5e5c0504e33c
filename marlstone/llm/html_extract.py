"""Main text of web pages by minimum cut.

A page becomes its text blocks in page order. A logistic classifier gives each block
the cost of either label from its text (length, stops, links), its tag, its place
relative to the first heading, the share of the page's prose under its container, and from
clues of its elements (article or nav and the like, naming words in class, id and role). A block of a content
element that no clue calls boilerplate is told so by a feature of its own, so an article's lists of links and table cells stay.
These costs are the terminal capacities. An element that holds most of the page's
prose gives no boilerplate clue, whatever it is called; where an article or main element
holds a good part of it, blocks outside are told so. Neighbouring blocks and neighbours under
one parent share smoothness edges, weaker the farther apart they are in the tree, whose
capacities are fitted like the costs. The minimum cut labels all blocks of the page at once: content or boilerplate.

The classifier is fitted to blocks whose elements tell their label: as they are, without
naming words, and without any clue, so that text and shape carry pages that have none. The edges' capacities are those
with which the cut is wrong least often without clues.

Content blocks keep their whole text: character references decoded, white space made
single spaces, blocks joined by an empty line.

Cases: a null or empty page, or one without content, has an empty text; markup that is
never closed reaches to the end; repeated rows are pages each; a very long page is read whole;
a block whose costs are equal is boilerplate unless its neighbours pull it; further columns aren't read; an empty table
gives an empty result, and too few pages leave the classifier at its prior weights.
"""

from __future__ import annotations

import html as html_library
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import logistic_fit

# Elements and naming words of common page layouts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("canvas datalist iframe noembed noframes script style svg template textarea title".split())
#: A block of these is its own container, any other one lies in its parent.
HOLDERS = frozenset("address article aside body center dd details dialog div footer form header main nav section td th".split())
#: An opening tag ends an open element of these, looked for up to one of the last three sets' containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
BOILERPLATE_TAGS = frozenset("nav footer aside form button select menu dialog label fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|menus|sidebar|side|aside|footer|foot|masthead|topbar|header|head|breadcrumbs?|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|comments?|commentlist|reply|replies|respond|disqus|share|sharing|social|related|recommend\w*|trending|popular|subscribe|newsletter|signup|login|search|widget|toolbar|pagination|pager|copyright|legal|disclaimer|tags?|form)(?:[^a-z]|$)"
)
CONTENT_NAMES = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|main|post|postbody|entry|story|body|text|prose)(?:[^a-z]|$)")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
_STOPS = re.compile(r"[.!?…。]")

FEATURES = ("content element", "boilerplate element", "boilerplate name", "content name", "outside the content element", "content element without a boilerplate clue", "links", "log length", "stops", "heading", "item", "paragraph", "after the heading", "share of prose")
#: Prior weights of FEATURES and the intercept.
PRIOR = np.array([2.0, -6.0, -6.0, 1.0, -4.0, 4.0, -3.0, 0.6, 1.0, 0.8, -0.8, 0.6, 0.6, 2.0, -2.4])
CLUES, NAMES = (0, 1, 2, 3, 4, 5), (2, 3)
#: Prior capacities of neighbours in the page and under one parent, the weakening of the first by each step in the tree beyond two, and the largest terminal capacity.
SMOOTH, SIBLING, STEP, LARGEST = 0.3, 1.5, 0.35, 9.0
#: Pairs of capacities that a fit tries.
CAPACITIES = [(a, b) for a in (0.0, 0.3, 0.7, 1.0, 1.5) for b in (0.0, 0.4, 1.0, 1.5, 2.5)]
#: Shares of the page's prose: an element of more is no boilerplate; a content element of more makes the rest outside.
MOST, GOOD_PART = 0.6, 0.3


class Block:
    __slots__ = ("parts", "chars", "linked", "parent", "element", "tag")

    def __init__(self, parent: int, element: int, tag: str):
        self.parts, self.chars, self.linked = [], 0, 0
        self.parent, self.element, self.tag = parent, element, tag


@dataclass
class Page:
    """Blocks with their texts, in page order; by element its parent and clues (1 content, 2 boilerplate element, 4 boilerplate name, 8 content name)."""

    blocks: list[tuple[str, Block]]
    parents: list[int]
    clues: list[int]


def blocks_of(page: str) -> Page:
    parents, clues, found = [-1], [0], []
    # Open elements: tag, number, whether in a content element.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    links, block = 0, None

    def text(piece: str) -> None:
        nonlocal block
        if not piece or piece.isspace():
            if block is not None and piece:
                block.parts.append(" ")
            return
        if block is None:
            tag, number, _ = next(x for x in reversed(stack) if x[0] in BLOCK_TAGS or not x[0])
            block = Block(number, stack[-1][1], tag)
            found.append(block)
        block.parts.append(piece)
        block.chars += len(piece)
        if links:
            block.linked += len(piece)

    def close_to(depth: int) -> None:
        nonlocal links, block
        while len(stack) > depth:
            tag = stack.pop()[0]
            links -= tag == "a"
            if tag in BLOCK_TAGS:
                block = None

    pos = 0
    while m := _TAG.search(page, pos):
        if m.start() > pos:
            text(page[pos : m.start()])
        pos = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            if name in BLOCK_TAGS:
                block = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
                if name not in BLOCK_TAGS and stack[depth][0] in BLOCK_TAGS:
                    break
            continue
        if name in RAW_TAGS:
            # An svg that ends itself is empty, and one that is never closed takes no text with it.
            ended = attributes.rstrip().endswith("/")
            if name != "svg" or not ended:
                stop = _RAW_END[name].search(page, pos)
                pos = stop.end() if stop else (pos if ended or name == "svg" else len(page))
            continue
        if name == "math" and attributes.rstrip().endswith("/"):
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID_TAGS:
            if name == "hr":
                block = None
            continue
        if name in BLOCK_TAGS:
            block = None
            inside, until = CLOSES.get(name, ((), ()))
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag in inside or tag == "p":
                    close_to(depth)
                    break
                if tag in until or (tag in BLOCK_TAGS and not inside):
                    break
        own, inside = 0, stack[-1][2]
        if name in CONTENT_TAGS:
            own, inside = 1, True
        elif name in BOILERPLATE_TAGS or (name == "header" and not inside):
            own = 2
        if attributes and name not in ("html", "body"):
            names = " ".join(_HUMP.sub(" ", a or b or c) for a, b, c in _NAMES.findall(attributes)).lower()
            if names:
                own |= 4 if BOILERPLATE_NAMES.search(names) else 8 if CONTENT_NAMES.search(names) else 0
            if _HIDDEN.search(attributes):
                own |= 4
        number = stack[-1][1]
        if own or name in BLOCK_TAGS:
            parents.append(number)
            clues.append(own)
            number = len(parents) - 1
        stack.append((name, number, inside))
        links += name == "a"
    text(page[pos:])
    out = []
    for b in found:
        words = " ".join(html_library.unescape("".join(b.parts)).split())
        if words:
            out.append((words, b))
    return Page(out, parents, clues)


def features(page: Page) -> np.ndarray:
    blocks, parents = page.blocks, page.parents
    # Numbers grow in page order: children add up to their parents from the last on, clues go down from the first on.
    prose = [0] * len(parents)
    for _, b in blocks:
        prose[b.element] += b.chars - b.linked
    for k in range(len(parents) - 1, 0, -1):
        prose[parents[k]] += prose[k]
    total = max(prose[0], 1)
    seen = [0] * len(parents)
    content = max((k for k, c in enumerate(page.clues) if c & 1), key=lambda k: prose[k], default=-1)
    good = content >= 0 and prose[content] >= GOOD_PART * total
    for k in range(1, len(parents)):
        own = page.clues[k]
        if prose[k] >= MOST * total:
            own &= ~6
        seen[k] = seen[parents[k]] | own | (16 if good and k == content else 0)
    heading = next((k for k, (_, b) in enumerate(blocks) if b.tag == "h1"), -1)
    x = np.empty((len(blocks), len(FEATURES)))
    for k, (t, b) in enumerate(blocks):
        f, stops = seen[b.element], len(_STOPS.findall(t))
        holder = parents[b.parent] if b.tag not in HOLDERS and parents[b.parent] >= 0 else b.parent
        x[k] = (
            f & 1 > 0, f & 2 > 0, f & 4 > 0, f & 8 > 0, good and not f & 16, f & 7 == 1, b.linked / max(b.chars, 1), math.log1p(len(t)) / 2, min(stops, 5) / 5 + (t[-1] in ".!?…。:"),
            b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th", "dt", "option"), b.tag in ("p", "blockquote", "pre"), 0 <= heading <= k, (prose[holder] / total) if holder else 0.0,
        )
    return x


def _edges(page: Page, smooth: float = SMOOTH, sibling: float = SIBLING) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity) of neighbours in the page and of neighbours under one parent."""
    found, last, parents = [], {}, page.parents
    for j, (_, b) in enumerate(page.blocks):
        if j:
            up, x, y = 0, page.blocks[j - 1][1].parent, b.parent
            while x != y and up < 12:  # numbers grow in page order, so the larger one can't be above the other
                if x > y:
                    x = parents[x]
                else:
                    y = parents[y]
                up += 1
            found.append((j - 1, j, smooth * STEP ** max(0, up - 2)))
        holder = parents[b.parent]
        if holder in last and last[holder] != j - 1:
            found.append((last[holder], j, sibling))
        last[holder] = j
    return found


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of the least cost: gain is the cost of boilerplate less that of content; an edge costs where labels differ.

    Nodes whose gain outweighs their edges are fixed first, which never changes the
    least cost; max-flow labels the others.
    """
    n = len(gain)
    gain, label = gain.astype(float).copy(), np.full(n, -1)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        around[i][j] = around[i].get(j, 0.0) + c
        around[j][i] = around[j].get(i, 0.0) + c
    pull = [sum(a.values()) for a in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] < 0 and abs(gain[i]) >= pull[i]:
            label[i] = int(gain[i] > 0)
            for j, c in around[i].items():
                if label[j] < 0:
                    gain[j] += c if label[i] else -c
                    pull[j] -= c
                    queue.append(j)
    rest = np.flatnonzero(label < 0).tolist()
    if rest:
        content = _source_side(rest, gain, around, label)
        for i in rest:
            label[i] = int(i in content)
    return label


def _source_side(rest: list[int], gain: np.ndarray, around: list[dict[int, float]], label: np.ndarray) -> set[int]:
    """Dinic's algorithm; the nodes that the source reaches once the flow is greatest."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: {j: c for j, c in around[i].items() if label[j] < 0} for i in rest}
    room[source] = {i: float(gain[i]) for i in rest if gain[i] > 0}
    room[sink] = {}
    for i in rest:
        if gain[i] < 0:
            room[i][sink] = float(-gain[i])
            room[sink][i] = 0.0
        elif gain[i] > 0:
            room[i][source] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        nexts = {i: list(room[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= 1e-9)
                path = path[: cut + 1]
                continue
            while nexts[i] and not (room[i].get(nexts[i][-1], 0.0) > 1e-9 and level.get(nexts[i][-1]) == level[i] + 1):
                nexts[i].pop()
            if nexts[i]:
                path.append(nexts[i][-1])
            else:
                path.pop()
                if path:
                    nexts[path[-1]].pop()


def labelled(page: Page, weights: np.ndarray, capacities: tuple[float, float] = (SMOOTH, SIBLING)) -> tuple[np.ndarray, np.ndarray]:
    """The label of each block by the cut, and by its own costs alone."""
    # The cost of boilerplate less that of content is the log odds of content.
    gain = np.clip(features(page) @ weights[:-1] + weights[-1], -LARGEST, LARGEST)
    return minimum_cut(gain, _edges(page, *capacities)), (gain > 0).astype(int)


def extract(html: str, weights: np.ndarray, capacities: tuple[float, float] = (SMOOTH, SIBLING)) -> tuple[str, int, int, int]:
    """The page's text, its content blocks, its blocks, and the labels that the cut changes."""
    page = blocks_of(html)
    if not page.blocks:
        return "", 0, 0, 0
    label, alone = labelled(page, weights, capacities)
    kept = [t for (t, _), y in zip(page.blocks, label, strict=True) if y]
    return "\n\n".join(kept), len(kept), len(page.blocks), int((label != alone).sum())


def told(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of features whose elements tell their label, and these labels."""
    no = (x[:, 1] > 0) | (x[:, 2] > 0) | (x[:, 4] > 0)
    yes = (x[:, 0] > 0) & ~no
    return np.flatnonzero(yes | no), yes[yes | no].astype(float)


def _sample(pages: DataFrame, max_pages: int) -> DataFrame:
    """The html of at most max_pages pages, taken by a hash of page_id and url."""
    # The pages are found by their keys alone; at most max_pages keys are broadcast, and one page stands for rows of one key.
    key = F.xxhash64(F.col("page_id").cast("string"), "url").alias("key")
    chosen = pages.where("html is not null").select(key).distinct().orderBy("key").limit(max_pages)
    return pages.where("html is not null").select("html", key).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("html").alias("html")).select("html")


def fit_blocks(pages: DataFrame, max_pages: int = 400, max_blocks: int = 200) -> np.ndarray:
    """Weights of FEATURES and the intercept, from the blocks of at most max_pages pages and max_blocks of each.

    The blocks of a longer page are taken evenly spread over
    it. Labels are those that elements tell; each block counts once as it is, once without naming words
    and once without clues.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                x = features(blocks_of(page or ""))
                at = told(x)[0]
                rows += x[at[np.unique(np.linspace(0, len(at) - 1, min(len(at), max_blocks)).astype(int))]].tolist() if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    rows = sorted(r["x"] for r in _sample(pages, max_pages).mapInArrow(run, "x array<double>").collect())
    if len(rows) < 100:
        return PRIOR.copy()
    x = np.array(rows)
    y = told(x)[1]
    unnamed, bare = x.copy(), x.copy()
    unnamed[:, NAMES] = 0.0
    bare[:, CLUES] = 0.0
    weight = np.full(3 * len(x), 100 / len(x))
    return logistic_fit(np.concatenate([x, unnamed, bare]), np.concatenate([y, y, y]), l2=4.0, weight=weight, prior=PRIOR)


def fit_capacities(pages: DataFrame, weights: np.ndarray, max_pages: int = 400, max_blocks: int = 2_000) -> tuple[float, float]:
    """Of CAPACITIES those with which the cut labels the fewest blocks wrong, of those whose elements tell their label, without any clue.

    From at most max_pages pages of at most max_blocks blocks; of equal ones the least. Few pages leave the prior ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(len(CAPACITIES), dtype=np.int64), 0
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = blocks_of(html or "")
                if not 0 < len(page.blocks) <= max_blocks:
                    continue
                x = features(page)
                at, y = told(x)
                x[:, CLUES] = 0.0
                gain = np.clip(x @ weights[:-1] + weights[-1], -LARGEST, LARGEST)
                n += len(at)
                wrong += [int((minimum_cut(gain, _edges(page, *c))[at] != y).sum()) for c in CAPACITIES]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(CAPACITIES)), pa.int32()), pa.array(wrong), pa.array([n] * len(CAPACITIES), pa.int64())], ["k", "wrong", "n"])

    rows = _sample(pages, max_pages).mapInArrow(run, "k int, wrong long, n long").groupBy("k").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).collect()
    if not rows or rows[0]["n"] < 100:
        return SMOOTH, SIBLING
    return CAPACITIES[min(rows, key=lambda r: (r["wrong"], sum(CAPACITIES[r["k"]]), r["k"]))["k"]]


def extract_text(pages: DataFrame, weights: np.ndarray | None = None, capacities: tuple[float, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_content_blocks, n_blocks, n_changed) for each row of pages (page_id, url, html); n_changed: labels that the cut changes."""
    weights = fit_blocks(pages) if weights is None else weights
    capacities = capacities or fit_capacities(pages, weights)
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = [extract(p or "", weights, capacities) for p in batch.column("html").to_pylist()]
                columns = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["page_id", "url", "text", "n_content_blocks", "n_blocks", "n_changed"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_content_blocks int, n_blocks int, n_changed int")
