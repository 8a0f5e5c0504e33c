"""Lookups that are no plain equality: containment, two-level codes, trigrams, set overlap.

All become equality joins on exploded parts, so none compares every row with every other.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.functions.text import trigrams
from marlstone.operators.similarity import best_by_thresholds, held_pairs, letters, similar_pairs
from marlstone.sources.scratch import materialise


def word_grams(text: Column, most: int) -> Column:
    """Distinct runs of 1 to most words of a text with single spaces."""
    words = F.split(text, " ")
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))))


def longest_contained(names: DataFrame, name: str, aliases: DataFrame, least: int = 4) -> DataFrame:
    """(name, entity, exact): the entity of the alias that equals the name, or else of the longest one that it holds as whole words.

    aliases: (alias, entity). Aliases shorter than ``least`` only count if equal. Names are taken
    apart into runs of as many words as the longest alias has: one number that the driver reads.
    """
    most_words = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    grams = names.select(name).distinct().select(name, F.explode(word_grams(F.col(name), most_words)).alias("alias"))
    hits = grams.join(aliases, "alias").withColumn("exact", F.col("alias") == F.col(name)).where(F.col("exact") | (F.length("alias") >= least))
    w = Window.partitionBy(name).orderBy(F.desc("exact"), F.desc(F.length("alias")), "alias", "entity")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(name, "entity", "exact")


def two_level(df: DataFrame, code: str, table: DataFrame, base: int, value: str) -> DataFrame:
    """df with value of its code, or of the code's first ``base`` characters; table: (code, value), short."""
    exact = table.select(F.col("code").alias(code), F.col(value).alias("_exact"))
    rough = table.where(F.length("code") == base).select(F.col("code").alias("_base"), F.col(value).alias("_rough"))
    found = df.join(exact, code, "left").withColumn("_base", F.substring(code, 1, base)).join(rough, "_base", "left")
    return found.withColumn(value, F.coalesce("_exact", "_rough")).drop("_exact", "_rough", "_base")


def best_trigram_match(names: DataFrame, name: str, candidates: DataFrame, candidate: str, others: bool = False) -> DataFrame:
    """(name, candidate, similarity): the candidate of the highest trigram Jaccard similarity, by name if equal; only ones that share a trigram.

    With ``others`` an equal candidate doesn't count.
    """
    side = lambda df, c, key: materialise(df.select(F.col(c).alias(key)).distinct().select(key, trigrams(F.col(key)).alias("items")), f"trigrams-{key}")
    left, right = side(names, name, "l"), side(candidates, candidate, "r")

    def pairs_at(df: DataFrame, t: float) -> DataFrame:
        pairs = similar_pairs(df, right, t).withColumnRenamed("similarity", "score")
        return pairs.where("l <> r") if others else pairs

    found = best_by_thresholds(left, pairs_at, (0.8, 0.6, 0.4, 0.2, 0.01))
    w = Window.partitionBy("l").orderBy(F.desc("similarity"), "r")
    return found.select("l", "r", F.round("score", 6).alias("similarity")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("l").alias(name), F.col("r").alias(candidate), "similarity")


def overlap_ranking(left: DataFrame, right: DataFrame, left_id: str, right_id: str, item: str, k: int) -> DataFrame:
    """(left_id, right_id, shared, rank): the k rows of right that share the most distinct items with each row of left."""
    shared = left.select(left_id, item).distinct().join(right.select(right_id, item).distinct(), item).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
    w = Window.partitionBy(left_id).orderBy(F.desc("shared"), right_id)
    return shared.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def name_similarity(q: Column, a: Column) -> Column:
    """The greatest of sequence ratio, trigram and word Jaccard of two normalised names; 0.8 at least where q has four letters and more and one holds the other."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, i, j).ratio() for i, j in zip(x, y, strict=True)], dtype=float)

    score = F.greatest(ratio(q, a), text.jaccard(text.trigrams(q), text.trigrams(a)), text.jaccard(F.array_distinct(F.split(q, " ")), F.array_distinct(F.split(a, " "))))
    held = (F.length(q) >= 4) & (q.contains(a) | a.contains(q))
    return F.when((q == "") | (a == ""), 0.0).otherwise(F.greatest(score, F.when(held, 0.8).otherwise(0.0)))


def resolve(queries: DataFrame, aliases: DataFrame, high: float = 0.82, medium: float = 0.55, least: float = 0.3) -> DataFrame:
    """(query, id, score, tier, confidence): the best entity for each row of queries (query) by the aliases (alias, id).

    Names are normalised; an equal one is exact, else the alias of the greatest ``name_similarity``
    wins, of equal ones the smallest id, exactly as if all were compared. Thresholds fall from 0.9 to
    ``least``, and at each one only queries without a match so far meet the aliases
    that may reach it by one of the signals: a sequence ratio of t takes letters in common (a Jaccard similarity of t / (2 - t)
    of the multisets), the others are joins of sets or of held texts. A query whose best alias stays below ``least``
    has a null id, score 0 and the confidence low.
    """
    names = materialise(aliases.select(text.normalize_surface(F.col("alias")).alias("a"), "id").where("a <> ''").distinct(), "aliases")
    asked = materialise(queries.select("query", text.normalize_surface(F.col("query")).alias("q")).distinct(), "asked")
    words = lambda c: F.array_distinct(F.split(c, " "))
    exact = names.groupBy(F.col("a").alias("q")).agg(F.min("id").alias("exact"))
    left = materialise(asked.where("q <> ''").select("q").distinct().join(exact, "q", "left_anti").select(F.col("q").alias("l")), "unmatched")
    right = materialise(names.select(F.col("a").alias("r")).distinct(), "names")
    sets = {f.__name__: right.select("r", f(F.col("r")).alias("items")) for f in (letters, trigrams)} | {"words": right.select("r", words(F.col("r")).alias("items"))}

    def pairs_at(df: DataFrame, t: float) -> DataFrame:
        near = [similar_pairs(df.select("l", letters(F.col("l")).alias("items")), sets["letters"], t / (2 - t)), similar_pairs(df.select("l", trigrams(F.col("l")).alias("items")), sets["trigrams"], t), similar_pairs(df.select("l", words(F.col("l")).alias("items")), sets["words"], t)]
        pairs = reduce(DataFrame.unionByName, [p.select("l", "r") for p in near])
        if t <= 0.8:
            pairs = pairs.unionByName(held_pairs(df, right))
        return pairs.distinct().withColumn("score", name_similarity(F.col("l"), F.col("r")))

    both = best_by_thresholds(left, pairs_at, [t for t in (0.9, 0.8, 0.7, medium) if t > least] + [least])
    best = both.join(names, F.col("r") == F.col("a")).groupBy(F.col("l").alias("q")).agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("best"))
    found = asked.join(best.select("q", F.col("best.id").alias("id"), (-F.col("best.less")).alias("score")), "q", "left")
    found = found.join(exact, "q", "left").withColumn("score", F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
    confidence = F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "med").otherwise("low")
    return found.select("query", F.coalesce("exact", "id").alias("id"), "score", F.when(F.col("exact").isNotNull(), "exact").otherwise("fuzzy").alias("tier"), confidence.alias("confidence"))


def suggest(queries: DataFrame, aliases: DataFrame, limit: int = 8) -> DataFrame:
    """(query, id, score, tier, rank): the ``limit`` best entities for each row of queries (query) by the aliases (alias, id).

    Names are normalised. An alias that begins with the query scores 1, one with a word that does 0.9; equal ones go by id. A
    query without any gets what ``resolve`` finds, as the tier ``fuzzy``. Blank queries have no row. The limit is the
    feature; it is taken for each prefix before queries are joined, so that a frequent one meets ``limit`` rows.
    """
    asked = queries.select("query", text.normalize_surface(F.col("query")).alias("p")).where("p <> ''").distinct()
    names = aliases.select(text.normalize_surface(F.col("alias")).alias("a"), "id").where("a <> ''").distinct()
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    whole = names.select("id", F.explode(prefixes(F.col("a"))).alias("p"), F.lit(1.0).alias("score"))
    words = names.select("id", F.explode(F.flatten(F.transform(F.split("a", " "), prefixes))).alias("p"), F.lit(0.9).alias("score"))
    hits = whole.unionByName(words).join(asked.select("p").distinct(), "p", "left_semi").groupBy("p", "id").agg(F.max("score").alias("score"))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= limit)
    found = asked.join(best, "p").select("query", "id", "score", F.lit("prefix").alias("tier"), "rank")
    rest = resolve(asked.join(best.select("p").distinct(), "p", "left_anti").select("query"), aliases).where("id is not null")
    return found.unionByName(rest.select("query", "id", "score", F.lit("fuzzy").alias("tier"), F.lit(1).cast("long").alias("rank")))
