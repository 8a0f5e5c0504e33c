"""Monotone pay curves: weighted isotonic fit, joined by a shape-preserving cubic, never extrapolated.

A group's points are aggregated before, a row for each observed band, so a group is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_YEARS = 25


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y in weighted squares (pooling adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The Fritsch-Carlson interpolant of (x, y); NaN outside x."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        for k in range(1, len(x) - 1):
            if d[k - 1] * d[k] > 0:
                a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = (a + b) / (a / d[k - 1] + b / d[k])
        for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            end = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if end * d0 <= 0:
                end = 0.0
            elif d0 * d1 <= 0 and abs(end) > 3 * abs(d0):
                end = 3 * d0
            m[k] = end
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    out = y[k] * (1 + 2 * t) * (1 - t) ** 2 + m[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t**2 * (3 - 2 * t) + m[k + 1] * h[k] * t**2 * (t - 1)
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def fit_curve(points: pd.DataFrame) -> pd.DataFrame:
    """(year, value, lo, hi, support) from points (low, high, median, n)."""
    empty = pd.DataFrame({"year": pd.Series(dtype="int64"), "value": pd.Series(dtype=float), "lo": pd.Series(dtype=float), "hi": pd.Series(dtype=float), "support": pd.Series(dtype=str)})
    p = points.dropna(subset=["low", "high", "median", "n"])
    if p.empty:
        return empty
    anchor = np.where(p["high"] - p["low"] > 12, p["low"], (p["low"] + p["high"]) / 2).round(1)
    p = p.assign(anchor=anchor, w=np.sqrt(np.maximum(p["n"], 1)))
    grouped = p.assign(wy=p["w"] * p["median"]).groupby("anchor", as_index=False)[["wy", "w"]].sum().sort_values("anchor")
    if len(grouped) < 2:
        return empty
    x, w = grouped["anchor"].to_numpy(float), grouped["w"].to_numpy(float)
    y = isotonic(grouped["wy"].to_numpy(float) / w, w)
    years = np.arange(np.floor(x[0]), min(np.ceil(x[-1]), MOST_YEARS) + 1)
    value = monotone_cubic(x, y, years)
    nearest = np.abs(years[:, None] - x[None, :]).min(axis=1)
    share = 0.06 + 0.10 * nearest / (x[-1] - x[0])
    support = np.where(np.isin(years, np.round(x)), "observed", "interpolated")
    out = pd.DataFrame({"year": years.astype("int64"), "value": value, "lo": value * (1 - share), "hi": value * (1 + share), "support": support})
    return out.dropna(subset=["value"])


def pay_curves(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, year, value, lo, hi, support) for each key of points (keys, low, high, median, n)."""
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = fit_curve(group)
        for place, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(place, name, value)
        return out

    return points.groupBy(*keys).applyInPandas(run, f"{kinds}, year long, value double, lo double, hi double, support string")
