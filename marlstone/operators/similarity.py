"""Set similarity joins by prefix filtering, and best matches by falling thresholds.

Two sets of a Jaccard similarity of t and more share one of their rarest items: of n items, in
one order from rare to frequent, the first n - ceil(t * n) + 1 are enough on each side. So only these meet in a
join; the sizes and the places of the first common item bound the overlap, and what is left is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialise

#: Guards products of thresholds and sizes against rounding up.
EPS = 1e-9


def least_overlap(t: float, n: Column) -> Column:
    """The items that a set of n shares with any set of similarity t and more."""
    return F.ceil(t * n - EPS)


def candidate_pairs(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(l, r): pairs of left (l, items) and right (r, items) that may have a Jaccard similarity of t and more; none of these is missing.

    Items have no repeats; rows without items meet nothing.
    """
    rare = right.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("rank"))
    order = Window.partitionBy("key").orderBy(F.coalesce("rank", F.lit(0)), "item")

    def prefix(df: DataFrame, key: str) -> DataFrame:
        exploded = df.select(F.col(key).alias("key"), F.size("items").alias("n"), F.explode("items").alias("item")).join(rare, "item", "left")
        placed = exploded.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - least_overlap(t, F.col("n")) + 1)
        return placed.select("item", F.col("key").alias(key), F.col("n").alias(f"n_{key}"), F.col("at").alias(f"at_{key}"))

    n, m = F.col("n_l"), F.col("n_r")
    met = prefix(left, "l").join(prefix(right, "r"), "item").where((m >= least_overlap(t, n)) & (n >= least_overlap(t, m)))
    first = met.groupBy("l", "r", "n_l", "n_r").agg(F.min("at_l").alias("at_l"), F.min("at_r").alias("at_r"))
    most = F.least(n - F.col("at_l"), m - F.col("at_r")) + 1
    return first.where(most >= F.ceil(t / (1 + t) * (n + m) - EPS)).select("l", "r")


def similar_pairs(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(l, r, similarity): all pairs of left (l, items) and right (r, items) of a Jaccard similarity of t and more."""
    pairs = candidate_pairs(left, right, t)
    both = pairs.join(left.select("l", F.col("items").alias("_x")), "l").join(right.select("r", F.col("items").alias("_y")), "r")
    shared = F.size(F.array_intersect("_x", "_y"))
    similarity = shared / (F.size("_x") + F.size("_y") - shared)
    return both.select("l", "r", similarity.alias("similarity")).where(F.col("similarity") >= t - EPS)


def letters(c: Column) -> Column:
    """The letters of a text as a set: each with its number so far, so that overlaps are those of multisets."""
    each = F.array_sort(F.split(c, ""))
    return F.transform(each, lambda x, i: F.concat(x, (i - F.array_position(each, x)).cast("string")))


def held_pairs(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(l, r): texts of left of ``least`` letters and more (3 at least), and those of right that they hold or that hold them.

    The rarest run of three letters of the shorter text is one of the longer text's runs; texts of one or two letters are met as
    they are. Empty texts have no pair.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
    long_left = left.select("l").where(F.length("l") >= max(least, 3))

    def inside(inner: DataFrame, x: str, outer: DataFrame, y: str) -> DataFrame:
        index = outer.where(F.length(y) >= 3).select(y, F.explode(runs(F.col(y), 3)).alias("run"))
        rare = index.groupBy("run").agg(F.count("*").alias("n"))
        probe = inner.where(F.length(x) >= 3).select(x, F.explode(runs(F.col(x), 3)).alias("run")).join(rare, "run", "left")
        probe = probe.groupBy(x).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best")).select(x, F.col("best.run").alias("run"))
        return probe.join(index, "run").where(F.col(y).contains(F.col(x))).select("l", "r")

    short = long_left.select("l", F.explode(F.array_union(runs(F.col("l"), 1), runs(F.col("l"), 2))).alias("r")).join(right.select("r"), "r").select("l", "r")
    return inside(long_left, "l", right.select("r"), "r").unionByName(inside(right.select("r"), "r", long_left, "l")).unionByName(short).distinct()


def best_by_thresholds(left: DataFrame, pairs_at: Callable[[DataFrame, float], DataFrame], thresholds: Sequence[float]) -> DataFrame:
    """The rows of ``pairs_at(open rows of left, t)``, (l, r, score), of the first threshold at which an l has any of score t and more.

    Where ``pairs_at`` misses no pair of score t and more, an l's best rows, ties too, are among them; only what
    is open goes on to the next, lower threshold, with its longer prefixes.
    """
    open_rows, found = left, []
    for t in thresholds:
        hits = materialise(pairs_at(open_rows, t).where(F.col("score") >= t - EPS), "matches")
        found.append(hits)
        open_rows = materialise(open_rows.join(hits.select("l").distinct(), "l", "left_anti"), "unmatched")
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
