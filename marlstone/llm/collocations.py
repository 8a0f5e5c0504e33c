"""Collocations of two to four words, by SETM: occurrence relations, level by level.

R(k) holds the occurrences of phrases of k words, sorted by place: words of one
piece have consecutive places, pieces leave a gap. It is a written table of chunks,
one row for each, of the texts of one language up to ``CHUNK`` bytes: its places and their
phrases as packed arrays, and its distinct phrases with their numbers. A level
is three steps. Merge-join: occurrences at adjacent places make one of the next length.
Group-count: each is a slot of a hash, and the chunks' numbers of their slots are added up, so
that a number is at least that of each of its phrases. Semi-join: each chunk gets back
a bit for each of its slots, and keeps the occurrences in slots of enough. So what occurs too rarely crosses the
network as a slot of about 13 bits, not as text, and is never written; a phrase that only
shares a slot is kept for now. At last the phrases of all levels are dealt as texts, and counted exactly.

A phrase costs an entry for each chunk, however often it occurs, and texts are read
once, where they lie: a common word or line, or a group of copies, is in no single
task. Phrases and slots are dealt into as many parts as their number asks for.

Cases: a null or empty text has no words, a null language is ``und``; repeated rows
count each; a very long text is a chunk of its own; ties go by smaller cut, then by
frequency and bytes of the phrase, as stated; further columns aren't read; an empty
table, or one without a frequent pair, gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: Bytes of text of a chunk, a single text aside.
CHUNK = 16 << 20
#: Chunks' phrases that are added up in one group, about.
PART = 2 << 20
#: Occurrences whose slots are added up in one group, about; slots for each occurrence.
SLOT_PART, SLOTS = 32 << 20, 2
LONGEST = 4

_LEVEL = "chunk long, lang string, n long, words long, next long, phrases binary, counts binary, at binary, item binary"
_PARTS = "part int, chunk long, lang string, phrases binary, counts binary, ids binary"
_SLOTS = "part int, chunk long, slots binary, counts binary"
_PASSED = "part int, chunk long, passed binary"
_FREQUENT = "lang string, phrase string, k int, f long"
_LEVEL_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("next", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary()), ("at", pa.binary()), ("item", pa.binary())])
_PARTS_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_SLOTS_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])
_PASSED_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("passed", pa.binary())])
_FREQUENT_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])
_PIECE_END, _WORD_END = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD_END[list(b".,;:!?\n\x0b\x0c\r \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _packed(a: np.ndarray) -> bytes:
    """32-bit numbers, byte planes one after the other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _packed_texts(texts: pa.Array) -> bytes:
    """Phrases, each with a line end, compressed."""
    ended = pc.binary_join_element_wise(texts, "", "\n")
    _, offsets, data = ended.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)
    return zstandard.ZstdCompressor(level=9).compress(memoryview(data)[ends[ended.offset] : ends[ended.offset + len(ended)]] if len(ended) else b"")


def _unpacked_texts(raw: bytes) -> pa.Array:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[b != 10])))


def _level_row(chunk: int, lang: str, phrases: pa.Array, counts: np.ndarray, at: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    """The row of a chunk; frequent phrases come first, as small numbers pack better."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    row = {"chunk": chunk, "lang": lang, "n": len(counts), "words": int(counts.sum()), "next": int((np.diff(at) == 1).sum())}
    row |= {"phrases": _packed_texts(phrases.take(pa.array(order))), "counts": _packed(counts[order]), "at": _packed(np.diff(at, prepend=0)), "item": _packed(rank[item])}
    return pa.RecordBatch.from_pylist([row], schema=_LEVEL_ARROW)


def _words(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in order, and of each occurrence its place and its word."""
    b = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    ends = _WORD_END[b]
    edge = np.flatnonzero(np.diff(ends.astype(np.int8), prepend=1, append=1))
    starts, stops = edge[::2], edge[1::2]
    piece = np.cumsum(_PIECE_END[b])[starts]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b[~ends]))).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    gaps = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    return words.dictionary.take(pa.array(order)).cast(pa.string()), np.arange(len(starts)) + gaps, rank[words.indices.to_numpy()]


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, task, chunk = defaultdict(list), defaultdict(int), TaskContext.get().partitionId(), 0

    def done(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        chunk += 1
        words, at, item = _words(b"\n".join(held.pop(lang)))
        size.pop(lang)
        if len(words):
            yield _level_row((task << 32) + chunk, lang, words, np.bincount(item, minlength=len(words)), at, item)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode()
            held[lang].append(raw)
            size[lang] += len(raw)
            if sum(size.values()) > CHUNK:
                yield from done(max(size, key=size.get))
    for lang in list(held):
        yield from done(lang)


def _dealt(parts: int):
    """A chunk's phrases with their numbers, by part of a hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                phrases, counts = _unpacked_texts(r["phrases"]), _unpacked(r["counts"])
                hashes = pd.util.hash_array(phrases.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)
                order = np.argsort(hashes, kind="stable")
                edges = np.searchsorted(hashes[order], np.arange(parts + 1, dtype=np.uint64)) if parts <= len(order) else np.append(np.flatnonzero(np.diff(hashes[order], prepend=hashes[order][:1] + np.uint64(1))), len(order))
                rows = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a:
                        ids = order[a:b]
                        rows.append({"part": int(hashes[ids[0]]), "chunk": r["chunk"], "lang": r["lang"], "phrases": _packed_texts(phrases.take(pa.array(ids))), "counts": _packed(counts[ids]), "ids": _packed(np.diff(ids, prepend=0))})
                yield pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)

    return deal


def _frequent(least: int):
    """Phrases of one part whose numbers add up to ``least`` and more."""

    def frequent(rows: pa.Table) -> pa.Table:
        by_lang, out = defaultdict(list), []
        for r in rows.to_pylist():
            by_lang[r["lang"]].append(r)
        for lang, own in by_lang.items():
            coded = pa.concat_arrays([_unpacked_texts(r["phrases"]) for r in own]).dictionary_encode()
            totals = np.zeros(len(coded.dictionary), dtype=np.int64)
            np.add.at(totals, coded.indices.to_numpy(), np.concatenate([_unpacked(r["counts"]) for r in own]))
            found = np.flatnonzero(totals >= least)
            phrases = coded.dictionary.take(pa.array(found))
            out.append(pa.Table.from_arrays([pa.array([lang] * len(found), pa.string()), phrases, pc.add(pc.count_substring(phrases, " "), 1).cast(pa.int32()), pa.array(totals[found])], schema=_FREQUENT_ARROW))
        return pa.concat_tables(out)

    return frequent


def _joined(row: dict, slots: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join: places are sorted, so an adjacent one is the next row. A chunk's phrases; of each occurrence of the next length its place, both parts and its slot."""
    at, item, phrases = np.cumsum(_unpacked(row["at"])), _unpacked(row["item"]), _unpacked_texts(row["phrases"])
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    own = pd.util.hash_array(phrases.to_numpy(zero_copy_only=False), categorize=False)
    mixed = own[item[first]] * np.uint64(0x9E3779B97F4A7C15) ^ own[item[first + 1]] ^ pd.util.hash_array(np.array([row["lang"]], dtype=object))
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return phrases, at[first], item[first], item[first + 1], ((mixed ^ mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _slotted(parts: int, width: int, least: int):
    """A chunk's slots with their numbers, by parts of ``width`` slots."""

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slots, counts = np.unique(_joined(r, parts * width)[-1], return_counts=True)
                edges = np.append(np.flatnonzero(np.diff(slots // width, prepend=-1)), len(slots))
                rows = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    part = int(slots[a] // width)
                    rows.append({"part": part, "chunk": r["chunk"], "slots": _packed(np.diff(slots[a:b], prepend=part * width)), "counts": _packed(np.minimum(counts[a:b], least))})
                yield pa.RecordBatch.from_pylist(rows, schema=_SLOTS_ARROW)

    return slotted


def _passed(width: int, least: int):
    """For each chunk a bit for each of its slots of one part: whether all chunks' numbers add up to ``least``."""

    def passed(rows: pa.Table) -> pa.Table:
        own, totals = rows.to_pylist(), np.zeros(width, dtype=np.min_scalar_type(least))
        for r in own:
            slots = np.cumsum(_unpacked(r["slots"]))
            totals[slots] = np.minimum(totals[slots] + _unpacked(r["counts"]), least)
        bits = [np.packbits(totals[np.cumsum(_unpacked(r["slots"]))] >= least) for r in own]
        return pa.Table.from_pylist([{"part": r["part"], "chunk": r["chunk"], "passed": zstandard.ZstdCompressor(level=1).compress(x.tobytes())} for r, x in zip(own, bits, strict=True) if x.any()], schema=_PASSED_ARROW)

    return passed


def _extend(parts: int, width: int):
    """Occurrences of one word more, of a chunk's relation and the bits of its slots."""

    def extend(passed: pa.Table, relation: pa.Table) -> pa.Table:
        if not len(passed) or not len(relation):
            return _LEVEL_ARROW.empty_table()
        row = relation.to_pylist()[0]
        phrases, at, left, right, slots = _joined(row, parts * width)
        found, slots = np.unique(slots, return_inverse=True)
        keep = np.zeros(len(found), dtype=bool)
        for r in passed.to_pylist():
            a, b = np.searchsorted(found, [r["part"] * width, (r["part"] + 1) * width])
            keep[a:b] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["passed"]), dtype=np.uint8), count=b - a)
        # Semi-join: occurrences in slots of enough only.
        keep = keep[slots]
        codes, made, counts = np.unique(left[keep] * len(phrases) + right[keep], return_inverse=True, return_counts=True)
        left, right = phrases.take(pa.array(codes // len(phrases))), phrases.take(pa.array(codes % len(phrases)))
        joined = pc.binary_join_element_wise(left, pc.replace_substring_regex(right, "^.* ", ""), " ")
        return pa.Table.from_batches([_level_row(row["chunk"], row["lang"], joined, counts, at[keep], made)])

    return extend


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of one to four words that occur ``least`` times in a language, and (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    level = materialise(texts.mapInArrow(_first_level, _LEVEL), "occurrences-1")
    words, dealt, before = level.groupBy("lang").agg(F.sum("words").alias("n")), None, 0
    for k in range(1, LONGEST + 1):
        n, occurrences = (x or 0 for x in level.agg(F.sum("n"), F.sum("next")).first())
        own = level.select("chunk", "lang", "phrases", "counts").mapInArrow(_dealt(1 + n // PART), _PARTS).select((F.col("part") + before).alias("part"), "lang", "phrases", "counts")
        dealt, before = own if dealt is None else dealt.unionAll(own), before + 1 + n // PART
        if k == LONGEST or not occurrences:
            break
        parts = 1 + occurrences // SLOT_PART
        width = 1 + SLOTS * occurrences // parts
        slotted = level.select("chunk", "lang", "phrases", "at", "item").mapInArrow(_slotted(parts, width, least), _SLOTS)
        passed = slotted.groupBy("part").applyInArrow(_passed(width, least), _PASSED)
        both = passed.groupBy("chunk").cogroup(level.select("chunk", "lang", "phrases", "at", "item").groupBy("chunk"))
        level = materialise(both.applyInArrow(_extend(parts, width), _LEVEL), f"occurrences-{k + 1}")
    return materialise(dealt.groupBy("part").applyInArrow(_frequent(least), _FREQUENT), "frequent"), words


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` phrases of each language that hold together best.

    A phrase of a occurrences, cut into parts of l and r ones, scores 2,000,000 * a // (l + r); its worst cut counts.
    Phrases that lie within a longer one of at least 0.8 times their occurrences go.
    """
    found, words = frequent_phrases(docs, least)
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    candidates = found.where("k > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))

    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    inside = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = candidates.drop("words").join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100BD < CAST(a AS DECIMAL(20, 0)) * 80BD").drop("longer")

    parts = found.where(F.col("k") < LONGEST).select("lang", F.col("phrase").alias("part"), "f")
    cuts = whole.withColumn("words", F.split("phrase", " ")).select("lang", "phrase", "a", "words", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).drop("left").join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]).drop("right")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst"))

    order = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
