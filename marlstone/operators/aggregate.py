"""Aggregates beyond the built-in ones.

Values are counted before they are shuffled or ordered, so a hot group costs a row for
each distinct value and task, not for each row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialise

#: Ranks that a sketch is asked for.
GRID = 256


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """(keys, n, a column for each quantile): the value at place round-half-even(q * (n - 1)), nulls left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    picked = [F.min(F.when(F.col("_to") > F.bround(q * (F.col("_n") - 1), 0).cast("long"), F.col(value))).alias(name) for name, q in quantiles.items()]
    return upto.groupBy(*keys).agg(F.max("_n").cast("long").alias("n"), *picked)


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, upper_median): the value at place n div 2, counted from 0."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    return upto.groupBy(*keys).agg(F.max("_n").cast("long").alias("n"), F.min(F.when(F.col("_to") > F.floor(F.col("_n") / 2), F.col(value))).alias("upper_median"))


def _closer(rows: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """State of groups whose brackets a sketch of the values within has narrowed, as far as the counts confirm it."""
    within = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    inner = rows.join(state, "_k").where(within)
    low, high = (F.floor((F.col("_n") + d) / 2) - F.col("_below") for d in (-1, 0))
    carried = [F.first(c).alias(c) for c in ("_n", "_low", "_high", "_below", "_inside", "_slack")]
    sketches = materialise(inner.groupBy("_k").agg(F.kll_sketch_agg_double("_v", k).alias("_s"), *carried), "sketches")
    # The function takes fixed ranks only: a grid of them, of which the next ones on both sides are picked.
    cut = sketches.withColumn("_q", F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))).drop("_s")
    share = lambda place, slack: ((place + 0.5) / F.col("_inside") + slack) * GRID
    at = lambda place: F.element_at("_q", F.greatest(F.lit(0), F.least(F.lit(GRID), place)).cast("int") + 1)
    cut = cut.withColumn("_a", at(F.floor(share(low, -F.col("_slack"))))).withColumn("_b", at(F.ceil(share(high, F.col("_slack"))))).drop("_q")
    counted = rows.join(cut, "_k").where(within).groupBy("_k").agg(*carried, F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.count(F.when(F.col("_v") < F.col("_a"), 1)).alias("_less"), F.count(F.when(F.col("_v").between(F.col("_a"), F.col("_b")), 1)).alias("_in"))
    held = (F.col("_less") <= low) & (high < F.col("_less") + F.col("_in"))
    new = lambda c, value: F.when(held, value).otherwise(F.col(c)).alias(c)
    return counted.select("_k", "_n", new("_low", F.col("_a")), new("_high", F.col("_b")), new("_below", F.col("_below") + F.col("_less")), new("_inside", F.col("_in")), F.when(held, F.col("_slack")).otherwise(F.col("_slack") * 2).alias("_slack"))


def _large_medians(rows: DataFrame, sizes: DataFrame, most: int, k: int) -> DataFrame:
    """(_k, _m): exact medians of groups of any size.

    A mergeable sketch brackets a group's middle places, counts of its rows below and within confirm the
    bracket, and the next sketch is of the values within, until ``most`` are left or all of them are equal; only these are
    counted and ordered.
    """
    ends = rows.join(sizes, "_k").groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = materialise(ends.select("*", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.lit(4.0 / k).alias("_slack")), "brackets")
    done = []
    for _ in range(12):  # each round leaves about 2 / GRID + 8 / k of the values; a missed bracket doubles its width
        wide = (F.col("_inside") > most) & (F.col("_low") < F.col("_high"))
        done.append(state.where(~wide))
        state = state.where(wide)
        if state.isEmpty():
            break
        state = materialise(_closer(rows, state, k), "brackets")
    else:
        done.append(state)
    brackets = done[0]
    for d in done[1:]:
        brackets = brackets.unionByName(d)
    inside = rows.join(brackets, "_k").where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    counts = inside.groupBy("_k", "_v", "_n", "_below").agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_to", F.col("_below") + F.sum("_c").over(Window.partitionBy("_k").orderBy("_v")))
    picked = [F.min(F.when(F.col("_to") > F.floor((F.col("_n") + d) / 2), F.col("_v"))) for d in (-1, 0)]
    return upto.groupBy("_k").agg(((picked[0] + picked[1]) / 2).alias("_m"))


def medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], aggregates: Sequence[Column] = (), bound: int | None = None, most: int = 1_000_000, k: int = 2048) -> DataFrame:
    """(keys, a median for each of values, aggregates): exact medians; nulls of a value are left out, a null key is a group.

    Groups of up to ``most`` rows have Spark's exact median, whose buffer they bound. Larger ones are found by
    sketches (``_large_medians``), so that no group's values meet in one buffer. ``bound`` is a number of rows
    that the table surely doesn't exceed: up to ``most``, one pass is enough; else the rows of each group are counted first.
    A NaN counts as the largest value, as in Spark's order.
    """
    plain = [F.median(c).alias(name) for name, c in values.items()]
    if bound is not None and bound <= most:
        return df.groupBy(*keys).agg(*plain, *aggregates)
    named = df.select(F.struct(*keys).alias("_k"), *[c.cast("double").alias(name) for name, c in values.items()])
    whole = materialise(df.groupBy(*keys).agg(F.count("*").alias("_rows"), *aggregates).withColumn("_k", F.struct(*keys)), "groups")
    large = whole.where(F.col("_rows") > most).select("_k")
    few = named
    if has_large := not large.isEmpty():
        few = named.join(large, "_k", "left_anti")
    found = few.groupBy("_k").agg(*[F.median(name).alias(name) for name in values])
    if has_large:
        rows = materialise(named.join(large, "_k", "left_semi"), "large-groups")
        wide = large
        for name in values:
            own = rows.select("_k", F.col(name).alias("_v")).where("_v IS NOT NULL")
            wide = wide.join(_large_medians(own, large, most, k).withColumnRenamed("_m", name), "_k", "left")
        found = found.unionByName(wide)
    rest = [c for c in whole.columns if c not in ("_rows", "_k", *keys)]
    return whole.join(found, "_k").select(*keys, *values, *rest)


def counted_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", most: int = 1_000_000, bound: int | None = None) -> DataFrame:
    """(keys, name, n): the exact median and number of a group's values; nulls left out, also as keys; groups without a value have no row."""
    kept = df.where(F.col(value).isNotNull()).dropna(subset=list(keys))
    return medians(kept, keys, {name: F.col(value)}, [F.count("*").alias("n")], bound=bound, most=most)


def with_pooled(df: DataFrame, keys: Sequence[str], band: str, aggregates: Sequence[Column], pooled: str = "pooled") -> DataFrame:
    """Aggregates by keys and band, and by keys alone under the band 'pooled'; rows of no band count in 'pooled' once."""
    sets = [[F.col(k) for k in keys] + [F.col(band)], [F.col(k) for k in keys]]
    named = df.withColumn(band, F.nullif(F.col(band), F.lit(pooled)))
    out = named.groupingSets(sets, *keys, band).agg(F.grouping(band).alias("_all"), *aggregates)
    return out.where(f"_all = 1 or {band} is not null").withColumn(band, F.when(F.col("_all") == 1, pooled).otherwise(F.col(band))).drop("_all")


def with_total(df: DataFrame, key: str, aggregates: Sequence[Column], total: str = "*") -> DataFrame:
    """Aggregates by key, and of all rows under the key '*'."""
    out = df.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates)
    return out.withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key))).drop("_all")


def known_share(value: Column, known: Column, digits: int = 4) -> Column:
    """The share of rows with value among the known ones; null without any."""
    hits = F.sum(F.when(value & known, 1).otherwise(0))
    return F.round(hits / F.nullif(F.sum(F.when(known, 1).otherwise(0)), F.lit(0)), digits)


def top_items(df: DataFrame, keys: Sequence[str], item: str, k: int) -> DataFrame:
    """(keys, items): the k most frequent items as a JSON list; equally frequent ones by name."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), item)
    ranked = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_r", item))), lambda x: x[item])
    return ranked.groupBy(*keys).agg(F.to_json(listed).alias("items"))


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, place: str) -> DataFrame:
    """(keys, value, n): the most frequent value; of equally frequent ones that which came first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(place).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first", value)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, value, "n")


def pair_counts(df: DataFrame, group: str, item: str, floor: int, most_items: int = 5) -> DataFrame:
    """(a, b, n): groups of 2 to most_items distinct items by pairs of them, a < b; pairs in at least floor groups.

    Groups are counted first, and only the items of groups of a fitting size are gathered, so large groups stay small.
    """
    distinct = df.select(group, item).distinct()
    small = distinct.groupBy(group).agg(F.count("*").alias("_n")).where(f"_n between 2 and {most_items}").select(group)
    sets = distinct.join(small, group, "left_semi").groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    pairs = F.flatten(F.transform("_items", lambda a, i: F.transform(F.slice("_items", i + 2, F.size("_items")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
