"""Tables brought up to date: first wins, last wins, by priority, authoritative sources, ledgers.

Each works on whole frames: rows of one key meet in one shuffle, by a window or an anti
join; nothing is updated row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Existing rows, and of the new ones the first of each key that is not there yet."""
    return existing.unionByName(pick(new, keys, order).join(existing.select(*keys), list(keys), "left_anti").select(existing.columns))


def last_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """New rows, the first of each key in the given order, in place of existing ones."""
    latest = pick(new, keys, order)
    return existing.join(latest.select(*keys), list(keys), "left_anti").select(existing.columns).unionByName(latest.select(existing.columns))


def by_priority(feeds: DataFrame, keys: Sequence[str], rank: Column | str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Of each key the row of the lowest rank; equal ranks go by order."""
    return pick(feeds, keys, [rank, *order])


def fill_gaps(authoritative: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the authoritative source, and the other's rows of keys that it lacks."""
    return authoritative.unionByName(other.join(authoritative.select(*keys).distinct(), list(keys), "left_anti").select(authoritative.columns))


def append_new(ledger: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append to a ledger: ids that it doesn't hold. Its own rows are never dated anew."""
    return found.join(ledger.select(*keys), list(keys), "left_anti")


def update_values(df: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """df with column replaced where changes hold a value for the key."""
    new = changes.select(*keys, F.col(column).alias("_new"))
    return df.join(new, list(keys), "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(df.columns)
