"""Postings that repeat within an employer's block, and roles derived from titles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import canon_title, normalize_surface, slug, word_runs
from marlstone.operators.components import components
from marlstone.operators.knn import first_links
from marlstone.operators.neighbours import indexed_groups
from marlstone.sources.scratch import materialise

REGISTERS, BANDS, BLOCK = 32, 8, 1024


#: Shingles of a batch whose minima are taken at once, a single text aside, and the factors of xxHash64.
AT_ONCE = 1 << 20
P1, P2, P3, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def reseeded(hashes: np.ndarray, i: int) -> np.ndarray:
    """``xxhash64(s, i)`` from ``xxhash64(s)``: the integer's hash with the string's as its seed."""
    h = (hashes.view(np.uint64) + (P5 + np.uint64(4))) ^ np.uint64(i * int(P1) % 2**64)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _minima(hashes: pd.Series) -> pd.Series:
    """For each row its least hash for each register; null without hashes."""
    out, rows = [None] * len(hashes), [(k, h) for k, h in enumerate(hashes) if len(h)]
    part = np.cumsum([len(h) for _, h in rows]) // AT_ONCE
    for p in np.unique(part):
        own = rows[np.searchsorted(part, p) : np.searchsorted(part, p, side="right")]
        flat, starts = np.concatenate([h for _, h in own]), np.cumsum([0, *(len(h) for _, h in own[:-1])])
        least = np.stack([np.minimum.reduceat(reseeded(flat, i), starts) for i in range(REGISTERS)], axis=1)
        for (k, _), m in zip(own, least, strict=True):
            out[k] = m
    return pd.Series(out, dtype=object)


def signatures(posts: DataFrame, key: str, block: Sequence[str], text: str) -> DataFrame:
    """(key, block, sig): MinHash minima of the five-word shingles of the whole normalised text; null and empty texts have zeros.

    Shingles are hashed where they are cut, one hash for all registers, and a text's minima are taken in its own row, so one row
    for each posting is shuffled.
    """
    words = F.filter(F.split(normalize_surface(F.col(text)), " "), lambda w: w != "")
    parts = posts.select(key, *block, words.alias("_w")).select(key, *block, F.transform(word_runs(F.col("_w")), lambda s: F.xxhash64(s)).alias("_h"))
    found = parts.select(key, *block, F.pandas_udf(_minima, "array<long>")("_h").alias("_m")).groupBy(key, *block).agg(*[F.min(F.col("_m")[i]).alias(f"_m{i}") for i in range(REGISTERS)])
    return found.select(key, *block, F.array(*[F.coalesce(f"_m{i}", F.lit(0).cast("long")) for i in range(REGISTERS)]).alias("sig"))


def repeated_postings(posts: DataFrame, key: str, block: Sequence[str], text: str, least: float = 0.8) -> DataFrame:
    """(key, group): postings of one block whose signatures agree in ``least`` of their places are linked; group is the smallest key reachable.

    At 26 of 32 equal places at most six of eight bands differ, so two agree: seven bands find every such pair. Equal
    signatures are one row first. The rows of a band are dealt into blocks, and a Spark group compares two of
    them, so that a frequent band is spread over groups of bounded size. Nulls of block columns are one value;
    a repeated key counts by its rows' shingles together; an empty table gives an empty result.
    """
    places = math.ceil(least * REGISTERS - 1e-9)
    if (REGISTERS - places) >= BANDS - 1:
        raise ValueError("bands can't find all pairs of so low a similarity")
    blocked = posts.withColumn("_b", F.struct(*block))
    sigs = materialise(signatures(blocked, key, ["_b"], text), "signatures")
    distinct = materialise(sigs.groupBy("_b", "sig").agg(F.min(key).alias("rep")), "distinct")
    width = REGISTERS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 2)), lambda i: F.struct(i.alias("band"), F.slice("sig", i * width + 1, width).alias("part")))
    banded = distinct.select("rep", "sig", "_b", F.explode(bands).alias("x")).select("rep", "sig", "_b", "x.band", "x.part")
    where = ["_b", "band", "part"]
    counts = banded.groupBy(*where).agg(F.count("*").alias("_n")).where("_n > 1").select(F.struct(*where).alias("_k"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts"))
    shared = banded.withColumn("_k", F.struct(*where)).join(counts, "_k")
    dealt = shared.withColumn("own", F.pmod(F.xxhash64("rep"), "_parts").cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("_b", "band", "part", "rep", "sig", "own", F.least("own", "mate").alias("low"), F.greatest("own", "mate").alias("high"))

    def links(group: pd.DataFrame) -> pd.DataFrame:
        sig, own, rep = np.stack(group["sig"].to_numpy()), group["own"].to_numpy(), group["rep"].to_numpy()
        a, b = np.flatnonzero(own == group["low"].iloc[0]), np.flatnonzero(own == group["high"].iloc[0])
        equal = np.zeros((len(a), len(b)), dtype=np.int8)
        for i in range(REGISTERS):
            equal += sig[a, i][:, None] == sig[b, i][None, :]
        u, v = first_links(equal >= places, a, b, len(group))
        return pd.DataFrame({"u": rep[u], "v": rep[v]})

    kind = posts.schema[key].dataType.simpleString()
    label = components(dealt.groupBy("_b", "band", "part", "low", "high").applyInPandas(links, f"u {kind}, v {kind}"))
    named = distinct.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(F.struct("_b", "sig").alias("_k"), F.coalesce("component", "rep").alias("group"))
    return sigs.select(key, F.struct("_b", "sig").alias("_k")).join(named, "_k").select(key, "group")


def derived_roles(posts: DataFrame, market: str, title: str, floor: int = 200, shown: int = 50) -> DataFrame:
    """(role_id, market, label_title, posting_count, member_titles): titles of a market that are one without level words, where at least ``floor`` postings have them.

    member_titles lists the first ``shown`` distinct titles by name as JSON. Rows without a market don't count; a null
    title is an empty one, and titles of level words alone are the role ``role``. Titles are counted before they are ordered.
    """
    titles = posts.where(F.col(market).isNotNull()).groupBy(F.col(market).alias("market"), F.coalesce(title, F.lit("")).alias("title")).agg(F.count("*").alias("n"))
    titles = titles.withColumn("canon", F.coalesce(F.nullif(canon_title(F.col("title")), F.lit("")), F.lit("role")))
    w = Window.partitionBy("market", "canon")
    ranked = titles.withColumn("_all", F.sum("n").over(w)).where(F.col("_all") >= floor).withColumn("_r", F.row_number().over(w.orderBy("title"))).where(F.col("_r") <= shown)
    listed = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]))
    rows = ranked.groupBy("market", "canon").agg(F.max("_all").alias("posting_count"), listed.alias("member_titles"))
    return rows.select(F.concat_ws(":", F.lit("derived"), F.lower("market"), slug(F.col("canon"))).alias("role_id"), "market", F.initcap("canon").alias("label_title"), "posting_count", "member_titles")


def clustered_roles(posts: DataFrame, key: str, market: str, title: str, vector: str, floor: int = 200, least: float = 0.68, shown: int = 50) -> DataFrame:
    """(role_id, market, label_title, posting_count, member_titles): clusters of near postings of a market, of ``floor`` members and more.

    Only markets of ``floor`` postings take part; a posting is a row with a market. A cluster is a component of the near
    vectors of its market (``indexed_groups``); it is named by the title without level words that most of its members have, of
    equal ones the first by name, ``role`` if that is empty. member_titles lists the first ``shown`` distinct titles by name as JSON. ``key`` names each row.
    """
    rows = posts.where(F.col(market).isNotNull()).select(key, F.col(market).alias("market"), F.coalesce(title, F.lit("")).alias("title"), F.col(vector).alias("_v"))
    large = rows.groupBy("market").agg(F.count("*").alias("_n")).where(F.col("_n") >= floor).select("market")
    rows = materialise(rows.join(large, "market", "left_semi"), "postings")
    groups = indexed_groups(rows, key, "_v", least, ["market"])
    titles = rows.drop("_v").join(groups.select(key, "group"), key).groupBy("market", "group", "title").agg(F.count("*").alias("n"))
    sizes = titles.groupBy("market", "group").agg(F.sum("n").alias("posting_count")).where(F.col("posting_count") >= floor)
    named = titles.join(sizes, ["market", "group"]).withColumn("canon", canon_title(F.col("title")))
    modes = named.groupBy("market", "group", "canon").agg(F.sum("n").alias("n")).groupBy("market", "group").agg(F.min(F.struct((-F.col("n")).alias("less"), "canon")).alias("mode"))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("market", "group").orderBy("title"))).where(F.col("_r") <= shown)
    listed = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]))
    found = first.groupBy("market", "group").agg(F.max("posting_count").alias("posting_count"), listed.alias("member_titles")).join(modes, ["market", "group"])
    label = F.coalesce(F.nullif("mode.canon", F.lit("")), F.lit("role"))
    return found.select(F.concat_ws(":", F.lit("derived"), F.lower("market"), slug(label)).alias("role_id"), "market", F.initcap(label).alias("label_title"), "posting_count", "member_titles")
