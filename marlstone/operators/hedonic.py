"""Log-linear premiums by ridge regression, from sums that partitions add up.

The design has a bounded number of columns: the most frequent items, and dummies of
the cell columns. Each task adds its rows' products, also for Poisson-weighted
bootstrap replicas, so that only matrices of that size are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent values of an array or plain column; equally frequent ones by name."""
    values = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    rows = df.select(values.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(k).collect()
    return [r["v"] for r in rows]


def premiums(df: DataFrame, y: str, items: str, cells: Sequence[str], key: str, k: int = 60, max_levels: int = 200, alpha: float = 1.0, replicas: int = 20, seed: int = 7) -> DataFrame:
    """(item, n, premium_pct, lo_pct, hi_pct, r2): the change in y that an item goes with, all else equal.

    df: y > 0, items (array), cells (columns of at most max_levels frequent levels each; others are one), key
    (a column whose hash draws a row's bootstrap weights). The interval holds the middle 95 % of the replicas.
    """
    spark = df.sparkSession
    names = sorted(frequent(df, items, k))
    levels = [(c, v) for c in cells for v in sorted(frequent(df, c, max_levels))]
    at_item, at_level = {v: i for i, v in enumerate(names)}, {x: len(names) + i for i, x in enumerate(levels)}
    width = len(names) + len(levels) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, target, square, mass = np.zeros((replicas + 1, width, width)), np.zeros((replicas + 1, width)), 0.0, np.zeros(2)
        hits = np.zeros(width)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.iloc[at : at + 4096]
                x = np.zeros((len(b), width))
                x[:, -1] = 1
                for row, own in enumerate(b[items]):
                    x[row, [at_item[v] for v in own if v in at_item]] = 1
                for c in cells:
                    place = b[c].map(lambda v, c=c: at_level.get((c, v), -1)).to_numpy()
                    x[np.flatnonzero(place >= 0), place[place >= 0]] = 1
                logs = np.log(b[y].to_numpy(float))
                draw = np.stack([np.ones(len(b))] + [_poisson(b["_h"].to_numpy("int64"), seed + r) for r in range(replicas)])
                for r in range(replicas + 1):
                    weighted = x * draw[r][:, None]
                    gram[r] += x.T @ weighted
                    target[r] += weighted.T @ logs
                square += float(logs @ logs)
                mass += (len(b), logs.sum())
                hits += x.sum(axis=0)
        yield pd.DataFrame({"replica": range(replicas + 1), "sums": [np.concatenate([gram[r].ravel(), target[r], hits, [square, *mass]]).tolist() for r in range(replicas + 1)]})

    rows = df.where(F.col(y) > 0).select(F.col(y).cast("double").alias(y), items, *cells, F.xxhash64(key).alias("_h"))
    parts = rows.mapInPandas(run, "replica int, sums array<double>")

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"replica": group["replica"].iloc[:1], "sums": [sum(np.asarray(s) for s in group["sums"])]})

    # Arrays are added up in two steps, 32 sums for each replica and then one: replicas arrays reach the driver.
    schema = "replica int, sums array<double>"
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    added = salted.groupBy("replica", "_salt").applyInPandas(add_up, schema).groupBy("replica").applyInPandas(add_up, schema)
    sums = np.zeros((replicas + 1, width * width + 2 * width + 3))
    for r in added.toPandas().itertuples():
        sums[r.replica] = r.sums
    ridge = np.diag([alpha] * (width - 1) + [0.0])
    effects = []
    for s in sums:
        gram, target = s[: width * width].reshape(width, width), s[width * width : width * width + width]
        effects.append(np.linalg.lstsq(gram + ridge, target, rcond=None)[0])
    beta, hits = effects[0], sums[0][width * width + width : width * width + 2 * width]
    gram, target = sums[0][: width * width].reshape(width, width), sums[0][width * width : width * width + width]
    square, n, total = sums[0][-3:]
    r2 = float(1 - (square - 2 * beta @ target + beta @ gram @ beta) / (square - total**2 / n)) if n else 0.0
    change = lambda b: (np.exp(b) - 1) * 100
    low, high = (np.percentile([change(e) for e in effects[1:]], q, axis=0) if replicas else change(beta) for q in (2.5, 97.5))
    rows = [(v, int(hits[i]), float(change(beta)[i]), float(low[i]), float(high[i]), r2) for v, i in at_item.items()]
    return spark.createDataFrame(rows, "item string, n long, premium_pct double, lo_pct double, hi_pct double, r2 double")


def _poisson(h: np.ndarray, seed: int) -> np.ndarray:
    """Weights of a Poisson distribution of mean 1, from each row's hash."""
    x = h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320.0])), u).astype(float)
