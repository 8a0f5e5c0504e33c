"""Training order: a keyed permutation of all sequences, written as fixed-stride shards.

Documents, each with an end id, follow one another within a task's input, and every
``row_ids`` ids make a sequence; a document may go on in the next one, and only the last
sequence of a task is padded. Sequences are a written table and get dense numbers from
its files' row counts and each row's place in its file. A keyed Feistel network permutes
the numbers: it permutes the least range of 4**k numbers that holds all, and walks its
cycle until it is back within range, so each sequence has a slot of its own in 0..n-1
and no table of the order exists. Consecutive slots make a shard: partitions are ranges
of slots, each writes whole shards in slot order. Slot k is in shard k // per_shard at
byte k % per_shard * stride, so a reader starts or resumes anywhere by arithmetic. The
folder ``manifest`` beside the shards has the key and these numbers.

Cases: a null or empty text is its end id alone; repeated rows are documents each; a
null doc_id is carried along; a very long text fills many sequences; further columns
aren't read; an empty table gives no slots and no shards. No two slots are equal, so
there are no ties. A retried or speculative task finds the shard in place and leaves it.

A folder holds one corpus: before its first shard it gets ``corpus``, a digest of the sequences and of all
that decides on their bytes, and after its last one ``manifest``. Writing the same again
leaves the shards; anything else in a folder that has a corpus is refused, so no slot ever names other bytes. Without a
manifest, a folder isn't whole: write again.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, scratch_dir
from marlstone.llm.tokens import encoder

ROUNDS = 6
#: Partitions that write shards, at most; beyond it a partition writes several shards, one after the other.
MOST_PARTITIONS = 20_000


def feistel(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number of 0..n-1 under the key: a permutation of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = number.astype(np.uint64)
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> shift, x[walking] & mask
        for r in range(ROUNDS):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        x[walking] = (left << shift) | right
        walking = walking[x[walking] >= np.uint64(n)]
    return x.astype(np.int64)


def id_type(tokenizer: str) -> str:
    """Unsigned 16-bit ids if the vocabulary allows it, else 32-bit ones; little-endian."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 65_536 else "<u4"


def sequences(docs: DataFrame, tokenizer: str, row_ids: int = 2048, end_id: int = 0) -> DataFrame:
    """(ids, digest, doc_ids, starts, lengths) for each sequence of docs (doc_id, text).

    digest is one of the ids. ids is binary, row_ids numbers of ``id_type`` compressed by Zstandard; the arrays tell the stretches of documents in
    it, one after the other: the ids of the document before the stretch, and its length.
    """
    kind, dtype = docs.schema["doc_id"].dataType.simpleString(), id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(tokenizer), pa.Codec("zstd", compression_level=3)
        held_ids, held = np.empty(0, dtype=dtype), None  # the open sequence's ids and stretches

        def made(ids: np.ndarray, doc: pa.Array, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
            """Whole sequences from stretches that fill them."""
            rows = len(ids) // row_ids
            first = np.searchsorted(np.cumsum(length) - length, np.arange(rows) * row_ids)
            offsets = pa.array(np.append(first, len(length)).astype(np.int32))
            each = [x.tobytes() for x in ids.reshape(rows, row_ids)]
            raw = pa.array([codec.compress(x, asbytes=True) for x in each], pa.binary())
            digest = pa.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in each], pa.int64())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (doc, pa.array(start), pa.array(length))]
            return pa.RecordBatch.from_arrays([raw, digest, *lists], ["ids", "digest", "doc_ids", "starts", "lengths"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, counts = encode.flat([t or "" for t in batch.column("text").to_pylist()], end_id)
                ids, doc = np.concatenate([held_ids, ids.astype(dtype)]), batch.column("doc_id")
                start = np.zeros(len(counts), dtype=np.int64)
                if held is not None:
                    doc, start, counts = pa.concat_arrays([held[0], doc]), np.concatenate([held[1], start]), np.concatenate([held[2], counts])
                # Cut the stretches where a sequence ends.
                last = np.cumsum(counts)
                cuts = np.union1d(last, np.arange(row_ids, last[-1] + 1, row_ids))
                owner = np.searchsorted(last, cuts)
                length = np.diff(cuts, prepend=0)
                start = start[owner] + cuts - length - (last - counts)[owner]
                doc, full = doc.take(pa.array(owner)), int(last[-1]) // row_ids * row_ids
                k = int(np.searchsorted(cuts, full, side="right")) if full else 0
                if full:
                    yield made(ids[:full], doc[:k], start[:k], length[:k])
                held_ids, held = ids[full:], (doc[k:], start[k:], length[k:])
        if len(held_ids):
            padded = np.concatenate([held_ids, np.full(row_ids - len(held_ids), end_id, dtype=dtype)])
            yield made(padded, *held)

    return docs.select("doc_id", "text").mapInArrow(run, f"ids binary, digest long, doc_ids array<{kind}>, starts array<long>, lengths array<long>")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, a written table, with number, dense from 0, and the count of rows. Only counts for each file reach the driver."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first, total = [], 0
    for r in sorted(placed.groupBy("file").agg(F.count("*").alias("n")).collect(), key=lambda r: r["file"]):
        first.append((r["file"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(first, "file string, first long")
    # A row for each file: the size is known, and Spark chooses the join beyond it.
    placed = placed.join(F.broadcast(starts) if len(first) <= 100_000 else starts, "file")
    return placed.withColumn("number", F.col("first") + F.col("row")).drop("file", "first", "row"), total


def write_training_order(docs: DataFrame, tokenizer: str, key: int = 20_240_229, per_shard: int = 2048, row_ids: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the shards; (doc_id, start, length, slot, offset, shard, sequence_crc32) for each stretch of a document of docs (doc_id, text).

    A stretch is of ``length`` ids from the document's id ``start`` on, in the sequence of the
    slot from its id ``offset`` on. sequence_crc32 is that of the sequence's bytes. Files are named
    ``shard-<number>.bin`` in ``path``, a new folder under spark.checkpoint.dir if none is given.
    """
    spark, dtype = docs.sparkSession, id_type(tokenizer)
    folder = path or f"{scratch_dir(spark)}/training-order-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    kind, stride = docs.schema["doc_id"].dataType.simpleString(), row_ids * int(dtype[-1])
    rows, n = numbered(materialise(sequences(docs, tokenizer, row_ids, end_id), "sequences"))
    manifest = (n, key, stride, row_ids, per_shard, dtype, end_id)
    _claim(spark, folder, _digest(rows, manifest))

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), n, key))

    shards = max(1, math.ceil(n / per_shard))
    parts = min(shards, MOST_PARTITIONS)
    placed = rows.withColumn("slot", slot("number"))
    # Ranges of slots of whole shards; slots are dense, so bounds need no sample of the rows.
    ranges = F.floor(F.floor(F.col("slot") / per_shard) * parts / shards).cast("int")
    ordered = placed.repartitionById(parts, ranges).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        codec = pa.Codec("zstd")
        store, base = fs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))
        store.create_dir(base, recursive=True)
        open_shard, out, held = None, None, ""

        def close() -> None:
            out.close()
            done = f"{base}/shard-{open_shard:08d}.bin"
            if store.get_file_info(done).type == fs.FileType.NotFound:
                store.move(held, done)
            else:  # of another try, with the same bytes
                store.delete_file(held)

        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    slots = batch.column("slot").to_numpy(zero_copy_only=False)
                    shard = slots // per_shard
                    ids = [codec.decompress(x, stride, asbytes=True) for x in batch.column("ids").to_pylist()]
                    for number in np.unique(shard).tolist():
                        if number != open_shard:
                            if out:
                                close()
                            held = f"{base}/writing-{number:08d}-{uuid.uuid4().hex}"
                            open_shard, out = number, store.open_output_stream(held)
                        own = np.flatnonzero(shard == number)
                        out.write(b"".join(ids[own[0] : own[-1] + 1]))
                    sums = np.array(list(map(zlib.crc32, ids)), dtype=np.int64)
                    lists = batch.column("doc_ids")
                    own = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                    length = batch.column("lengths").flatten().to_numpy()
                    last = np.cumsum(length)
                    offset = (last - length) - np.repeat(*_first_of(own, last - length))
                    columns = [lists.flatten(), batch.column("starts").flatten(), pa.array(length), pa.array(slots[own]), pa.array(offset), pa.array(shard[own]), pa.array(sums[own])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "slot", "offset", "shard", "sequence_crc32"])
            if out:
                close()
                out = None
        finally:
            if out:  # a failed try leaves no file
                out.close()
                if store.get_file_info(held).type != fs.FileType.NotFound:
                    store.delete_file(held)

    ordered = ordered.select("slot", "ids", "doc_ids", "starts", "lengths")
    found = materialise(ordered.mapInArrow(run, f"doc_id {kind}, start long, length long, slot long, offset long, shard long, sequence_crc32 long"), "training-order")
    spark.createDataFrame([manifest], "sequences long, key long, stride long, row_ids long, per_shard long, dtype string, end_id long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return found


def _digest(rows: DataFrame, manifest: tuple) -> str:
    """A digest of all numbered sequences and of the manifest; sums over rows, so their order doesn't matter."""
    parts = [F.xxhash64("number", "digest", "doc_ids", "starts", "lengths", F.lit(seed)) for seed in (1, 2)]
    sums = rows.agg(*[F.sum(p.cast("decimal(38, 0)")) for p in parts]).first()
    return hashlib.sha256(repr((manifest, [str(x) for x in sums])).encode()).hexdigest()


def _claim(spark: SparkSession, folder: str, digest: str) -> None:
    """Write the digest of the folder's corpus, or refuse a folder that has another one."""
    spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("ignore").json(f"{folder}/corpus")
    found = [r.digest for r in spark.read.schema("digest string").json(f"{folder}/corpus").collect()]
    if found != [digest]:
        raise ValueError(f"{folder} holds the shards of another corpus: take another folder")


def _first_of(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first value of each run of group, and the lengths of the runs."""
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    return value[edge], np.diff(np.append(edge, len(group)))
