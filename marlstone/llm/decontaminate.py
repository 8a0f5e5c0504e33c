"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Texts are words (runs of letters and digits, lower-cased). The CGK embedding walks
along a sequence: at step j it writes the current word and moves on if bit j of the
word's hash is set, so that sequences at a small edit distance have embeddings at a
small Hamming distance. All windows of a document walk at once, one array operation
for each step. Each of WALKS embeddings is sampled at STEPS positions SAMPLES times;
a window whose sampled words equal an item's is a candidate, and the edit distance
between the whole item and the words around the window decides (Myers' bit-vectors).

An item of up to WINDOW words is one window, of its own size; a longer one is cut into
as many equal windows side by side as WINDOW asks for, and gets further ones every STRIDE words and at
its end. Of m windows side by side one at least holds no more than edits / m edits, rounded
down, wherever the edits are: in a run, at an end or scattered. A walk has twice as many steps as its window has
words, so it reaches the end. Only windows of a document in which all words but that
number occur in some item of the size are walked, so this loses no such window; the walks' samples
are random, and tests/llm measures recall for every length from 10 to 59 words by kind of edit.

Cases: a null or empty text, or item, matches nothing; items of equal words are all
reported; an empty benchmark or corpus gives an empty result; a document that holds
an item repeatedly has one row for it, of its best place, the first of equal ones; repeated rows are
searched each; a very long text is searched whole; further columns aren't read, and kept
by ``drop_contaminated``. A benchmark of any size is taken in blocks of ITEM_BLOCK items,
each a pass over the corpus; all items pass the driver, and each task holds one block.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WALKS, SAMPLES, STEPS = 6, 8, 4
WINDOW, STRIDE = 20, 4
ITEM_BLOCK = 10_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> str:
    """text in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distance_within(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """The least edit distance between item and a stretch of text, and where the stretch ends; None if above most."""
    masks: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        masks[w] |= 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best = full, 0, len(item), (len(item), 0)
    for at, w in enumerate(text):
        eq = masks[w] if w in masks else 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


def windows_of(n: int) -> tuple[int, list[int]]:
    """Words of the windows for an item of n words, and where they start."""
    parts = math.ceil(n / WINDOW)
    size = n if parts == 1 else n // parts // 2 * 2  # even, so that there are few sizes
    return size, sorted({*range(0, n - size, STRIDE), *range(0, n - size + 1, size), n - size})


def least_edits(n: int, share: float) -> int:
    """The edits that one window at least of an item of n words doesn't exceed, if the item's own share is kept."""
    return math.floor(share * n + 1e-9) // (n // windows_of(n)[0])


def sampled_steps(size: int, walk: int) -> tuple[list[int], list[list[int]]]:
    """The steps at which a walk is sampled, and for each sample its places among them."""
    steps = 2 * size
    rng = np.random.default_rng([size, walk])
    chosen = [np.sort(rng.choice(steps, size=min(STEPS, steps), replace=False)).tolist() for _ in range(SAMPLES)]
    wanted = sorted({j for c in chosen for j in c})
    return wanted, [[wanted.index(j) for j in c] for c in chosen]


def embed(sequence: np.ndarray, starts: np.ndarray, bits: np.ndarray, wanted: list[int], size: int) -> np.ndarray:
    """The CGK embedding of the windows of ``size`` words from each start on, at the wanted steps: (steps, starts) of words.

    bits: (2, words + 1), the step bits of each word; the last word stands for all others and for the end.
    """
    other = bits.shape[1] - 1
    at, ends, out, place = starts.copy(), starts + size, [], 0
    padded = np.append(sequence, other)
    for j in range(wanted[-1] + 1):
        here = np.where(at < ends, padded[np.minimum(at, ends)], other)
        if j == wanted[place]:
            out.append(here)
            place += 1
        at += ((bits[j // 64][here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return np.stack(out)


def sample_keys(embedded: np.ndarray, places: list[int]) -> np.ndarray:
    key = np.zeros(embedded.shape[1], dtype=np.uint64)
    for k in places:
        key = _mixed(key * _MIX + embedded[k].astype(np.uint64) + np.uint64(1))
    return key


@dataclass
class SizeClass:
    """The windows of one size."""

    size: int
    most_other: int
    known: np.ndarray
    #: By walk: sampled steps, and by sample: places, sorted keys, windows.
    walks: list[tuple[list[int], list[tuple[list[int], np.ndarray, np.ndarray]]]]


class ItemIndex:
    """Items as word ids with their sampled embeddings; built once in each task from a block of items."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.share, self.vocabulary, self.names, self.sequences = share, {}, [], []
        for name, text in items:
            if found := words(text or ""):
                self.names.append(name)
                self.sequences.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found])
        n = len(self.vocabulary)
        self.bits = [np.stack([_mixed(np.arange(n + 1, dtype=np.uint64) * _MIX + np.uint64(7919 * (2 * walk + half) + 1)) for half in (0, 1)]) for walk in range(WALKS)]
        by_size = defaultdict(list)
        #: By window: its item and where it starts there.
        self.windows: list[tuple[int, int]] = []
        for k, s in enumerate(self.sequences):
            size, starts = windows_of(len(s))
            for at in starts:
                by_size[size].append(len(self.windows))
                self.windows.append((k, at))
        self.classes = []
        for size, members in sorted(by_size.items()):
            own = np.array([self.sequences[k][at : at + size] for k, at in (self.windows[w] for w in members)], dtype=np.int64)
            known = np.zeros(n + 1, dtype=np.int32)
            known[own.ravel()] = 1
            whole = np.append(own, np.full((len(own), 1), n), axis=1)  # walks end within their window
            walks = []
            for walk in range(WALKS):
                wanted, samples = sampled_steps(size, walk)
                embedded = embed(whole.ravel(), np.arange(len(own)) * (size + 1), self.bits[walk], wanted, size)
                tables = []
                for places in samples:
                    key = sample_keys(embedded, places)
                    order = np.argsort(key, kind="stable")
                    tables.append((places, key[order], np.array(members)[order]))
                walks.append((wanted, tables))
            most_other = max(least_edits(len(self.sequences[self.windows[w][0]]), share) for w in members)
            self.classes.append(SizeClass(size, most_other, known, walks))

    def candidates(self, sequence: np.ndarray) -> np.ndarray:
        """Distinct (start, window) whose sampled embeddings agree; sequence: word ids of texts one after the other."""
        found = []
        for c in self.classes:
            if len(sequence) < c.size:
                starts = np.arange(0)
            else:
                sums = np.concatenate([[0], np.cumsum(c.known[sequence])])
                starts = np.flatnonzero(sums[c.size :] - sums[: -c.size] >= c.size - c.most_other)
            for walk, (wanted, tables) in enumerate(c.walks):
                for at in range(0, len(starts), 100_000):
                    own = embed(sequence, starts[at : at + 100_000], self.bits[walk], wanted, c.size)
                    for places, keys, members in tables:
                        key = sample_keys(own, places)
                        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                        hit = np.flatnonzero(high > low)
                        times = (high - low)[hit]
                        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        found.append(np.stack([np.repeat(starts[at : at + 100_000][hit], times), members[np.repeat(low[hit], times) + offset]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)

    def matches(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: by item, the least distance and the words from and to which it stretches."""
        get, other = self.vocabulary.get, len(self.vocabulary)
        ids = [[get(w, other) for w in words(t)] for t in texts]
        ends = np.cumsum([len(x) for x in ids])
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not self.sequences or not len(ends) or not ends[-1]:
            return out
        found = self.candidates(np.array([w for x in ids for w in x], dtype=np.int64))
        if not len(found):
            return out
        item, offset = np.array(self.windows)[found[:, 1]].T
        doc = np.searchsorted(ends, found[:, 0], side="right")
        begin = found[:, 0] - offset - (ends[doc] - np.array([len(x) for x in ids])[doc])
        order = np.lexsort((begin, item, doc))
        at = 0
        rows = np.stack([doc, item, begin], axis=1)[order].tolist()
        while at < len(rows):
            d, k, first = rows[at]
            own, text = self.sequences[k], ids[d]
            most = math.floor(self.share * len(own) + 1e-9)
            last, at = first, at + 1
            # Places near one another are searched as one stretch.
            while at < len(rows) and rows[at][:2] == [d, k] and rows[at][2] <= last + 2 * most + 1:
                last, at = rows[at][2], at + 1
            if k in out[d] and out[d][k][0] == 0:
                continue
            low = max(0, first - most)
            stretch = text[low : max(0, last) + len(own) + 2 * most]
            there = set(stretch)
            if sum(w not in there for w in own) > most:  # each of these words takes an edit
                continue
            if got := distance_within(own, [-1 if w == other else w for w in stretch], most):
                distance, end = got[0], low + got[1]
                back = distance_within(own[::-1], text[max(0, end - len(own) - most) : end][::-1], most)
                start = end - (back[1] if back and back[0] == distance else len(own))
                if k not in out[d] or distance < out[d][k][0]:
                    out[d][k] = (distance, max(0, start), end)
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of about ITEM_BLOCK."""
    items = benchmark.select("item_id", "text")
    count = max(1, math.ceil(items.count() / ITEM_BLOCK))
    for block in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and item that it holds.

    An item is held if at most ``share`` of its words have to be edited; start and end are
    code points of the best stretch. docs: (doc_id, text); benchmark: (item_id, text).
    """
    doc, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc}, item_id {item}, distance int, start int, end int"

    def finder(items: list[tuple[object, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, share)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = [t or "" for t in batch.column("text").to_pylist()]
                    rows = []
                    for k, held in enumerate(index.matches(texts)):
                        places = [m.span() for m in _WORD.finditer(lowered(texts[k]))] if held else []
                        rows += [(k, index.names[i], d, places[first][0], places[end - 1][1]) for i, (d, first, end) in sorted(held.items())]
                    columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], benchmark_type), *(pa.array(c, pa.int32()) for c in columns[2:])],
                        ["doc_id", "item_id", "distance", "start", "end"],
                    )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    benchmark_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for items in _blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(finder(items), schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""

    def keeper(items: list[tuple[object, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, share)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    held = index.matches([t or "" for t in batch.column("text").to_pylist()])
                    yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        return run

    for items in _blocks(benchmark):
        docs = docs.mapInArrow(keeper(items), docs.schema)
    return docs
