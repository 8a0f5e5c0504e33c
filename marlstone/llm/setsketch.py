"""Near-duplicates by SetSketch registers over word shingles, with exact links.

A document's set holds its distinct word shingles. Register i is the floor of
1 - log_b of the least of one exponential value for each shingle, cut to [0, q + 1]:
the registers of a union are the maxima, and similar sets share registers. Bands of
registers make buckets. Each member of a bucket is paired with its leader, the member
of the smallest doc_id; a pair's similarity is estimated from its registers by maximum
likelihood, and pairs that can reach the threshold are verified on the full sets.
Buckets of three and more that then still hold several components have the members
outside their largest component compared with all others, in blocks: with a large
component as a whole, likeliest members first, until one is linked; else pair by
pair. So no link between bucket-mates is lost. Both sides of a comparison are dealt
into blocks, and a group of a task holds one block or two. Joins by bucket or
component are of written tables, so that a hot one is split as a skewed key.

With 40 bands of 5 registers, a pair at the threshold 0.75 shares no bucket with
probability 2e-5, and its estimate is low by 0.15 with less than 1e-6.

Cases: a null or empty text, or one without words, has no shingles and is linked with
nothing. A text of fewer words than a shingle is one shingle. Texts with equal words
are one class and stand for each other. Rows that repeat a doc_id are one document;
if their texts differ, the text of the smallest print stands for it. A null doc_id is
linked with nothing, kept, and has a null component. A very long text is a set like any
other; blocks are dealt by the number of shingles. Further columns aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise
from marlstone.operators.components import components

BANDS, BAND_ROWS = 40, 5
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, LAST = 1.001, 20.0, 65_534
MARGIN = 0.15
#: Documents and shingles of a block; members from which on a component is compared as a whole.
BLOCK, BLOCK_SHINGLES, LARGE = 1_000, 400_000, 64

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word, kept by word in the worker."""
    from xxhash import xxh3_64_intdigest

    if len(_WORDS) > 120_000:
        _WORDS.clear()
    try:
        found = list(map(_WORDS.__getitem__, words))
    except KeyError:
        for w in set(words):
            if w not in _WORDS:
                _WORDS[w] = xxh3_64_intdigest(w)
        found = list(map(_WORDS.__getitem__, words))
    return np.array(found, dtype=np.uint64)


def shingles(text: bytes | None, width: int = 5) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct 64-bit hashes of the shingles, and the words."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64), words
    h = word_hashes(words)
    n = max(1, len(words) - width + 1)
    s = np.full(n, min(len(words), width), dtype=np.uint64)
    for k in range(min(width, len(words))):
        s = s * _ODD + h[k : k + n]
        s ^= s >> np.uint64(29)
    return np.unique(_mixed(s)), words


def registers(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * seeds).min(axis=0), out=least)
    value = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1.0 - np.log(value) / np.log(BASE)), 0, LAST + 1).astype("<u2")


def seeds() -> np.ndarray:
    return _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, print, registers): print is equal for equal words; the last two are null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        own = seeds()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                counts, prints, found = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    s, words = shingles(text, width)
                    counts.append(len(s))
                    prints.append(xxh3_128_digest(b" ".join(words)) if words else None)
                    found.append(registers(s, own).tobytes() if words else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "n_shingles", "print", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, print binary, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _bands(reps: DataFrame) -> DataFrame:
    """(key, rep): a row for each band of reps (rep, registers)."""
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = _matrix(batch.column("registers")).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]) * _ODD
                for k in range(BAND_ROWS):
                    key = _mixed(key ^ r[:, :, k]) * _ODD
                at = np.repeat(np.arange(batch.num_rows), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column("rep").take(pa.array(at))], ["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(run, f"key long, rep {kind}")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets of known sizes, given their registers row by row."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likelihood = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose sets can reach the similarity ``least``, and their estimates.

    A register is shared with the probability of the similarity, so that a pair at 0.75 shares
    fewer than 90 of 200 with less than 1e-15: such pairs need no estimate.
    """
    at = np.flatnonzero((np.minimum(na, nb) >= least * np.maximum(na, nb)) & ((a == b).sum(axis=1) >= (least - 2 * MARGIN) * a.shape[1]))
    found = [estimate(a[at[k : k + 2000]], b[at[k : k + 2000]], na[at[k : k + 2000]], nb[at[k : k + 2000]]) for k in range(0, len(at), 2000)]
    got = np.concatenate(found) if found else np.empty(0)
    return at[got >= least - MARGIN], got[got >= least - MARGIN]


def _likely_pairs(members: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(x, y): members (rep, leader) of buckets with those of their leaders that they can be linked with."""
    kind = reps.schema["rep"].dataType.simpleString()
    pairs = members.where("rep <> leader").groupBy(F.col("rep").alias("x")).agg(F.collect_set("leader").alias("leaders"))  # BANDS leaders at most
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}")).hint("merge")
    both = pairs.join(side("x"), "x").select("x", "nx", "rx", F.explode("leaders").alias("y")).join(side("y"), "y").where(f"least(nx, ny) >= {least!r} * greatest(nx, ny)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                size = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                keep = pa.array(likely(_matrix(batch.column("rx")), _matrix(batch.column("ry")), size("nx"), size("ny"), least)[0])
                yield pa.RecordBatch.from_arrays([batch.column("x").take(keep), batch.column("y").take(keep)], ["x", "y"])

    return both.select("x", "y", "nx", "ny", "rx", "ry").mapInArrow(run, f"x {kind}, y {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) for the documents in wanted (rep), of the text that stands for each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        last = None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, keep, sets = whole.slice(at, 500), [], []
                for k, (rep, text, own) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("print").to_pylist(), strict=True)):
                    if rep != last:  # rows that repeat a doc_id come one after the other, or in parts of a split key: then they are links found twice
                        s, words = shingles(text, width)
                        if words and xxh3_128_digest(b" ".join(words)) == own:
                            keep.append(k)
                            sets.append(s.tobytes())
                            last = rep
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], ["rep", "shingles"])

    named = wanted.distinct().join(reps.select("rep", "print"), "rep")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(named.hint("merge"), "rep")
    return texts.select("rep", "text", "print").mapInArrow(run, f"rep {kind}, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets reach the threshold."""
    kind = sets.schema["rep"].dataType.simpleString()
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")).hint("merge")
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, keep = whole.slice(at, 500), []
                for k, (a, b) in enumerate(zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True)):
                    n = (len(a) + len(b)) // 8
                    shared = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                    if 100 * shared >= percent * (n - shared):
                        keep.append(k)
                at_kept = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("x").take(at_kept), batch.column("y").take(at_kept)], ["x", "y"])

    return both.select("x", "y", "sx", "sy").mapInArrow(run, f"x {kind}, y {kind}")


def _mixed_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, rep, component, main): the rows of buckets (key, rep) that hold several components; main is the largest there."""
    named = members.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialise(named, "named-members")
    by_component = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = by_component.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
    buckets = materialise(buckets.select("key", F.col("largest.component").alias("main")), "mixed-buckets")
    return materialise(named.join(buckets, "key"), "mixed-rows")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")


def _blocks(rows: str, shingles: str) -> Column:
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _large_links(strays: DataFrame, nodes: DataFrame, large: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): for each stray (main, rep) a member of its large main component that it is linked with, if any, in each of its blocks.

    nodes: (rep, component, n, registers); large: (component, members, shingles). A component's
    members and its strays are dealt into blocks of about BLOCK each; a group holds one of either.
    """
    kind, least = reps.schema["rep"].dataType.simpleString(), percent / 100
    strays = materialise(strays.distinct().join(reps.hint("merge"), "rep").select("main", "rep", "n", "registers"), "strays")
    mains = strays.groupBy("main").agg(F.count("*").alias("strays"), F.sum("n").alias("stray_shingles")).join(large.withColumnRenamed("component", "main"), "main")
    mains = materialise(mains.select("main", _blocks("members", "shingles").alias("blocks"), _blocks("strays", "stray_shingles").alias("dealt")), "mains")
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = nodes.withColumnRenamed("component", "main").join(mains, "main").select("main", _block("blocks").alias("block"), to("dealt").alias("other"), "rep", "n", "registers", F.lit(False).alias("stray"))
    sent = strays.join(mains, "main").select("main", to("blocks").alias("block"), _block("dealt").alias("other"), "rep", "n", "registers", F.lit(True).alias("stray"))
    rows = own.unionByName(sent).join(sets.hint("merge"), "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(group["registers"]), dtype="<u2").reshape(-1, REGISTERS)
        n, stray, rep = group["n"].to_numpy().astype(float), group["stray"].to_numpy(), group["rep"].to_numpy()
        found = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        mates, pairs = np.flatnonzero(~stray), []
        for i in np.flatnonzero(stray):
            at, got = likely(np.broadcast_to(r[i], (len(mates), REGISTERS)), r[mates], np.full(len(mates), n[i]), n[mates], least)
            # The likeliest first; one link joins the components.
            for j in mates[at[np.argsort(-got, kind="stable")]]:
                shared = len(np.intersect1d(found[i], found[j], assume_unique=True))
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    pairs.append((rep[i], rep[j]))
                    break
        return pd.DataFrame(pairs, columns=["x", "y"])

    return rows.select("main", "block", "other", "rep", "stray", "n", "registers", "shingles").groupBy("main", "block", "other").applyInPandas(run, f"x {kind}, y {kind}")


def _rest_pairs(rows: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(x, y): pairs of bucket-mates in different components that can reach the threshold.

    rows: of ``_mixed_buckets``, but for the members of large main components. A bucket's rows
    are dealt into blocks of about BLOCK; a group holds one block or two.
    """
    kind = reps.schema["rep"].dataType.simpleString()
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    sizes = materialise(sizes.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "bucket-sizes")
    rows = rows.join(sizes, "key").withColumn("own", _block("blocks")).withColumn("stray", F.col("component") != F.col("main"))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "mate")).withColumn("high", F.greatest("own", "mate"))
    rows = rows.join(reps.hint("merge"), "rep").select("key", "low", "high", "own", "rep", "component", "stray", "n", "registers")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(group["registers"]), dtype="<u2").reshape(-1, REGISTERS)
        n, part = group["n"].to_numpy().astype(float), group["component"].to_numpy()
        stray, rep, own = group["stray"].to_numpy(), group["rep"].to_numpy(), group["own"].to_numpy()
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        found = []
        for i in np.flatnonzero(own == low):
            # Each two of a block once, or one of either block; two members of the main component need no test.
            mates = rep > rep[i] if low == high else own == high
            at = np.flatnonzero(mates & (part != part[i]) & (stray | stray[i]))
            if len(at):
                at = at[likely(np.broadcast_to(r[i], (len(at), REGISTERS)), r[at], np.full(len(at), n[i]), n[at], least)[0]]
                found.append(pd.DataFrame({"x": np.minimum(rep[at], rep[i]), "y": np.maximum(rep[at], rep[i])}))
        return pd.concat(found) if found else pd.DataFrame({"x": rep[:0], "y": rep[:0]})

    return rows.groupBy("key", "low", "high").applyInPandas(run, f"x {kind}, y {kind}").distinct()


def _own_texts(sketched: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """sketched without the texts that don't stand for their doc_id, and (doc_id, stands): the print of each doc_id with several."""
    named = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("stands"), F.max("print").alias("last"), F.count("*").alias("rows"), F.count("print").alias("texts"))
    several = materialise(named.where("stands <> last or (texts > 0 and texts < rows)").select("doc_id", "stands"), "several-texts")
    if several.isEmpty():
        return sketched, None
    return sketched.join(several, "doc_id", "left").where("stands is null or stands = print").drop("stands"), several


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    least = percent / 100
    sketched = materialise(sketch(docs, width), "sketches")
    own, several = _own_texts(sketched)
    reps = own.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "registers")).alias("first"))
    reps = materialise(reps.select("print", "first.*"), "representatives")

    bands = _bands(reps)
    leaders = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = materialise(bands.join(materialise(leaders, "leaders"), "key"), "buckets")
    candidates = materialise(_likely_pairs(members, reps, least), "candidates")
    crowded = members.where("size > 2").select("key", "rep")
    wanted = candidates.select(F.explode(F.array("x", "y")).alias("rep")).unionByName(crowded.select("rep"))
    sets = materialise(_sets(docs, wanted, reps, width), "sets")
    ends = lambda p: p.select(F.col("x").alias("u"), F.col("y").alias("v"))
    label = materialise(components(ends(_verified(candidates, sets, percent))), "labels")

    rows = _mixed_buckets(crowded, label)
    nodes = materialise(label.withColumnRenamed("node", "rep").join(reps.hint("merge"), "rep").select("rep", "component", "n", "registers"), "labelled")
    large = materialise(nodes.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where(f"members >= {LARGE}"), "large-components")
    # All strays of a bucket are compared with a large main component as a whole, so its members leave the bucket.
    rows = materialise(rows.join(large.select(F.col("component").alias("main"), F.lit(True).alias("whole")), "main", "left"), "open-rows")
    strays = rows.where("whole and component <> main").select("main", "rep")
    rest = _rest_pairs(rows.where("whole is null or component <> main").drop("whole"), reps, least)
    more = _verified(materialise(rest, "rest-pairs"), sets, percent)
    more = materialise(ends(more).unionByName(ends(_large_links(strays, nodes, large, reps, sets, percent))), "links-of-strays")
    # Links between components, by their names; components() also names nodes without a label.
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = more.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined = materialise(components(joined).select(F.col("node").alias("component"), F.col("component").alias("last")), "joined-components")

    classes = reps.select("print", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = classes.join(joined, "component", "left").select("print", F.coalesce("last", "component").alias("component"))
    if several is not None:
        sketched = sketched.join(several, "doc_id", "left").withColumn("print", F.coalesce("stands", "print"))
    found = sketched.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, with all its columns.

    Of rows that repeat a doc_id one stays, the one whose text has the smallest hash; rows without a doc_id all stay.
    """
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = materialise(kept.withColumnRenamed("doc_id", "kept_id"), "kept")
    found = docs.join(kept, docs["doc_id"] == kept["kept_id"])
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", *(F.xxhash64(c) for c in docs.columns))
    again = found.where("times > 1").withColumn("times", F.row_number().over(first)).where("times = 1")
    return found.where("times = 1").unionByName(again).select(docs.columns).unionByName(docs.where("doc_id is null"))
