"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and an end id; one longer than a sequence is cut into whole
sequences and a rest. Pieces are dealt into partitions of bounded size, and each
is packed best-fit decreasing. Dual feasible functions give each partition a lower
bound of its bins. In each round, partitions hand out their least filled bins, a
certified partition only its last ones, to fewer exchange partitions, which pack
these pieces again. It ends when the number of all bins meets the bound of all
pieces, or a single exchange partition is left. Bins are kept, never split by a
limit: every piece is in exactly one.

Cases: a null or empty text is a document of its end id alone; repeated rows are
documents each; a null doc_id is carried along; a very long text is cut into pieces;
pieces of equal length are taken in the order of their numbers; further columns aren't
read; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise
from marlstone.llm.tokens import encoder


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]); uid is unique once the table is written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, counts = encode.flat([t or "" for t in batch.column("text").to_pylist()], end_id)
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(size, counts[doc] - start)
                first = 4 * ((np.cumsum(counts) - counts)[doc] + start)
                raw = memoryview(ids.tobytes())
                parts = [raw[a:b] for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                columns = [
                    pa.array(np.arange(uid, uid + len(doc))),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(list(map(bytes, parts)), pa.binary()))
                uid += len(doc)
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions f0 (all its parameters) and u (1 to 24)."""
    if not len(sizes):
        return 0
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(histogram, sizes, counts)
    x = np.arange(capacity + 1, dtype=np.int64)
    number, mass = np.cumsum(histogram), np.cumsum(histogram * x)
    k = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]  # of more than capacity - k tokens: each fills a bin
    small = mass[np.maximum(k - 1, 0)]  # of fewer than k tokens: not counted
    best = int(np.max(-(-(large * capacity + mass[capacity - k] - small) // capacity)))
    for p in range(1, 25):
        whole = (p + 1) * x % capacity == 0
        doubled = np.where(whole, x * p, (p + 1) * x // capacity * capacity)  # p times u
        best = max(best, -(-int((histogram * doubled).sum()) // (capacity * p)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, best-fit decreasing, and the fill of each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []  # bit r: some bin has room for r tokens
    for i in order.tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if room > s:
            open_by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, offsets, np.array(fills, dtype=np.int64)


def _pack_round(pieces: DataFrame, number: int, buckets: int, capacity: int, hand_out: int) -> DataFrame:
    """(uid, length, sequence_id, offset, released) for the pieces (uid, length)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        sizes = group["length"].to_numpy()
        bins, offsets, fills = best_fit(sizes, capacity)
        gap = len(fills) - lower_bound(sizes, np.ones(len(sizes), dtype=np.int64), capacity)
        # The room of a certified partition's last bins can still serve another partition.
        out = np.argsort(fills, kind="stable")[: hand_out * (1 + max(gap, 0))]
        released = np.isin(bins, out[fills[out] < capacity]) if buckets > 1 or number == 0 else np.zeros(len(bins), dtype=bool)
        first = (number << 58) + (int(key[0]) << 22)
        return pd.DataFrame({"uid": group["uid"].to_numpy(), "length": sizes, "sequence_id": first + bins, "offset": offsets, "released": released})

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(run, "uid long, length long, sequence_id long, offset long, released boolean")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, per_bucket: int = 8192, hand_out: int = 24) -> DataFrame:
    """(uid, sequence_id, offset) for each row of pieces (uid, length), which must be a written table."""
    count = pieces.count()
    if not count:
        return pieces.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bound = packing_bound(pieces, capacity)
    rest, kept, buckets, number, bins = pieces.select("uid", "length"), [], max(1, math.ceil(count / per_bucket)), 0, 0
    while True:
        done = materialise(_pack_round(rest, number, buckets, capacity, hand_out), f"packing-{number}")
        of = done.agg(F.count_distinct(F.when(~F.col("released"), F.col("sequence_id"))).alias("kept"), F.count_distinct("sequence_id").alias("all"), F.count(F.when(F.col("released"), 1)).alias("released")).first()
        if not of["released"] or bins + of["all"] <= bound or number >= 30:
            kept.append(done)
            break
        kept.append(done.where("not released"))
        bins += of["kept"]
        rest = done.where("released").select("uid", "length")
        number, buckets = number + 1, max(1, math.ceil(of["released"] / per_bucket)) if number else max(1, min(math.ceil(of["released"] / per_bucket), (buckets + 1) // 2))
        if number > 1 and buckets > 1:
            buckets = max(1, buckets // 2)
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found.select("uid", "sequence_id", "offset")


def packing_bound(pieces: DataFrame, capacity: int = 2048) -> int:
    """Sequences that any packing of the pieces (length) needs; the driver sees one count for each length."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    return lower_bound(np.array([r["length"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64), capacity)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of docs (doc_id, text)."""
    pieces = materialise(token_pieces(docs, tokenizer, size, end_id, with_ids), "pieces")
    placed = pack_pieces(pieces, size)
    return pieces.join(placed, "uid").drop("uid")
