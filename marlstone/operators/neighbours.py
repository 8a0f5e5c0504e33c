"""A sparse graph of near vectors from an index of coarse cells, instead of all pairs.

The index is a set of centres, fitted on a bounded sample. A vector lives in the cell of its
nearest centre and looks for neighbours in the ``probes`` cells whose centres
are nearest; a pair is compared if one of the two looks into the other's cell. Cells hold about
``CELL_ROWS`` vectors up to ``MOST_CELLS`` cells, then they grow. The cells to look into grow as cells ** 0.45,
twice that number, which keeps recall for vectors at a cosine of 0.7 and more in the hard case of directions without any
clusters (tested; clustered vectors are found more easily). One cell is an exact search.

Equal vectors are one row. A cell of many vectors is dealt into blocks of its own and of those
that look into it, and a Spark group compares two of them, so that a hot cell is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.components import components
from marlstone.operators.knn import first_links
from marlstone.sources.scratch import materialise

CELL_ROWS, MOST_CELLS, BLOCK = 1024, 8192, 2048
#: Vectors for each cell that the centres are fitted on.
SAMPLE_ROWS = 4


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))


def fit_centres(distinct: DataFrame, vector: str, cells: int, rounds: int = 4) -> np.ndarray:
    """Unit centres by spherical k-means on ``SAMPLE_ROWS`` vectors a cell, those first in the order of a hash."""
    sample = distinct.orderBy(F.xxhash64(vector)).limit(cells * SAMPLE_ROWS).select(vector).toPandas()[vector]
    x = _unit(sample)
    centres = x[:cells]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _cells(distinct: DataFrame, block: Sequence[str], vector: str, cells: int | None, probes: int | None) -> DataFrame:
    """(rep, block, x, cell, home): a row of each vector for each cell that it looks into."""
    cells = cells or min(MOST_CELLS, max(1, math.ceil(distinct.count() / CELL_ROWS)))
    probes = min(cells, probes or math.ceil(2 * cells**0.45))
    named = distinct.select("rep", *block, F.col(vector).alias("x"))
    if cells == 1:
        return named.withColumns({"cell": F.lit(0), "home": F.lit(True)})
    centres = fit_centres(distinct, vector, cells)

    def look(x: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(x), 1024):
            near = _unit(x.iloc[a : a + 1024]) @ centres.T
            first = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            order = np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable"), axis=1)
            out.extend(order.astype(np.int32).tolist())
        return pd.Series(out)

    looked = named.withColumn("cells", F.pandas_udf(look, "array<int>")("x"))
    return looked.select("rep", *block, "x", F.posexplode("cells").alias("at", "cell")).withColumn("home", F.col("at") == 0).drop("at")


def _compared(vectors: DataFrame, key: str, vector: str, block: Sequence[str], cells: int | None, probes: int | None):
    """Distinct vectors, and the pairs of blocks of each cell: those that live there, and those that look into it."""
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(F.coalesce(vector, F.array().cast("array<double>"))) > 0))
    distinct = materialise(kept.groupBy(*block, vector).agg(F.min(key).alias("rep")), "vectors")
    looked = materialise(_cells(distinct, block, vector, cells, probes), "cells")
    where = [*block, "cell"]
    sides = looked.groupBy(*where).agg(F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).cast("int").alias("_own"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_all")).where("_own > 0")
    sides = materialise(sides.select(F.struct(*where).alias("_k"), "_own", "_all"), "sides")
    dealt = looked.withColumn("_k", F.struct(*where)).join(sides, "_k")
    part = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    here = dealt.where("home").select("_k", "rep", "x", part(F.col("_own"), 1).alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_j"))
    there = dealt.select(F.col("_k").alias("_m"), F.col("rep").alias("mate"), F.col("x").alias("y"), part(F.col("_all"), 2).alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("_a"))
    return distinct, here.groupBy("_k", "_i", "_j").cogroup(there.groupBy("_m", "_a", "_b"))


def neighbour_graph(vectors: DataFrame, key: str, vector: str, k: int = 32, least: float = 0.68, block: Sequence[str] = (), cells: int | None = None, probes: int | None = None) -> DataFrame:
    """(key, neighbour, similarity, rank): for each distinct vector its k most similar other ones, of a cosine of ``least`` and more.

    Equal vectors are named by the smallest key. Vectors of different ``block`` columns aren't compared.
    Null, empty and zero vectors have no neighbours.
    """
    kind = vectors.schema[key].dataType.simpleString()
    _, pairs = _compared(vectors, key, vector, block, cells, probes)

    def compare(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({key: [], "neighbour": [], "similarity": []})
        x, y, found = _unit(here["x"]), _unit(there["y"]), []
        own, other = here["rep"].to_numpy(), there["mate"].to_numpy()
        for ids, mates, sims in ((other, own, y @ x.T), (own, other, x @ y.T)):
            sims = np.where(ids[:, None] == mates[None, :], -2, np.round(sims.astype(np.float64), 6))
            order = np.lexsort((np.broadcast_to(mates, sims.shape), -sims), axis=1)[:, :k]
            value = np.take_along_axis(sims, order, axis=1)
            keep = value >= least
            found.append(pd.DataFrame({key: np.repeat(ids, keep.sum(axis=1)), "neighbour": mates[order][keep], "similarity": value[keep]}))
        return pd.concat(found)

    found = pairs.applyInPandas(compare, f"{key} {kind}, neighbour {kind}, similarity double").dropDuplicates([key, "neighbour"])
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def indexed_groups(vectors: DataFrame, key: str, vector: str, least: float = 0.68, block: Sequence[str] = (), cells: int | None = None, probes: int | None = None) -> DataFrame:
    """(key, block, group): components of the vectors of one block that a cosine of ``least`` and more links; group is the smallest key.

    Each pair of blocks of a cell sends at most one link for each of its rows, which keeps all that it finds connected, so there
    is no cap on neighbours. Null, empty and zero vectors are linked with none.
    """
    kind = vectors.schema[key].dataType.simpleString()
    distinct, pairs = _compared(vectors, key, vector, block, cells, probes)

    def links(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"u": [], "v": []})
        rep = np.concatenate([here["rep"].to_numpy(), there["mate"].to_numpy()])
        near = _unit(here["x"]) @ _unit(there["y"]).T >= np.float32(least - 1e-6)
        u, v = first_links(near, np.arange(len(here)), np.arange(len(here), len(rep)), len(rep))
        return pd.DataFrame({"u": rep[u], "v": rep[v]})

    label = components(pairs.applyInPandas(links, f"u {kind}, v {kind}")).withColumnRenamed("node", "rep")
    named = distinct.join(label, "rep", "left").select(F.struct(*block, vector).alias("_k"), F.coalesce("component", "rep").alias("group"))
    return vectors.select(key, *block, F.struct(*block, vector).alias("_k")).join(named, "_k", "left").select(key, *block, F.coalesce("group", key).alias("group"))
