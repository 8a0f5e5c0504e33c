"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects a document whose rate exceeds a cutoff. All rules' cutoffs go down a
fixed grid together, most lenient first; a document's place is the first step of the
grid at which some rule rejects it. A labelled holdout of good documents decides how far
down each language group may go: a step is accepted while the exact binomial tail
P(Bin(n, alpha) <= documents that any rule rejects) stays within the group's error share, and the
first step that isn't accepted ends the search (fixed-sequence testing, so the grid
itself costs nothing). The error ``delta`` is divided by the number of groups (Bonferroni).
With probability 1 - delta, the rules together reject at most ``alpha`` of the good
documents of each group. Equal texts of a group are one draw of the holdout.

Cases: a null or empty text has no words and fails the base rules; a null language
is a group of its own; repeated rows count once each in the result; without labels, or too few
for a bound, a group has no cutoffs and keeps whatever passes the base rules; a rate that
equals a cutoff passes it; a very long text is read whole; further columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rules: the rate's name and the largest cutoff of its grid.
RULES = {"symbol_rate": 4.0, "dup_line_rate": 1.0, "repeat_rate": 1.0, "upper_rate": 1.0, "shout_rate": 4.0, "mean_word": 64.0}
GRID_STEP = 0.88
GRID_SIZE = 48


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def rule_features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_group, print, counts, rates, base_failed) for each row of docs (doc_id, text, lang)."""
    text = F.col("text")
    d = docs.select("doc_id", F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    stripped = F.btrim(text, F.lit(SPACE))
    d = d.select(
        "doc_id",
        F.coalesce("lang", F.lit("(none)")).alias("lang_group"),
        F.xxhash64("text").alias("print"),
        F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: _without(line, SPACE) > 0).alias("lines"),
        F.length(text).alias("chars"),
        _without(text, SPACE).alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (F.length(text) - _without(text, "!?")).alias("n_shouts"),
    )
    n = F.size("words")
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(
        "*",
        n.alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(n >= 3, F.slice(windows, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).drop("words", "lines")
    # Only texts with a repeated window need the places of the windows.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select("*", F.when(repeats, placed).alias("placed")).drop("windows")
    twice = F.filter("placed", lambda e, k: (e["h"] == F.get("placed", k - 1)["h"]) | (e["h"] == F.get("placed", k + 1)["h"]))
    d = d.select("*", F.sort_array(F.transform(twice, lambda e: e["i"])).alias("starts")).drop("placed")
    # A repeated window adds the words up to the next repeated one, three at most.
    added = F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3))))
    repeated = F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0))
    d = d.select("*", repeated.alias("n_repeat_words")).drop("starts")
    long = {c: F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rates = {
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "shout_rate": rate("n_shouts", "n_words"),
        "mean_word": rate("word_chars", "n_words"),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))
    return d.select("doc_id", "lang_group", "print", *[c.alias(k) for k, c in long.items()], failed.alias("base_failed"), *[c.alias(k) for k, c in rates.items()])


def _place(value: Column, largest: float) -> Column:
    """The first place of the grid whose cutoff the value exceeds; GRID_SIZE if none does."""
    import math

    at = F.floor(F.log(value / largest) / math.log(GRID_STEP)).cast("int") + 1
    return F.when(value <= 0, F.lit(GRID_SIZE)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(GRID_SIZE)))


def place() -> Column:
    """The first step of the grid at which some rule rejects."""
    return F.least(*[_place(F.col(r), top) for r, top in RULES.items()])


def binomial_tail_within(n: Column, k: Column, alpha: float, delta: Column) -> Column:
    """Whether P(Bin(n, alpha) <= k) <= delta, exactly but for double precision."""
    kd, nd = k.cast("double"), n.cast("double")
    choose = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((nd - kd + i) / i))
    top = choose + kd * F.log(F.lit(alpha)) + (nd - kd) * F.log(F.lit(1 - alpha))
    # Each smaller count's term by the next one's: i / (n - i + 1) * (1 - alpha) / alpha; below the mode they shrink.
    down = F.when(k >= 1, F.sequence(k, F.greatest(F.lit(1).cast("long"), k - 20 * F.ceil(F.sqrt(nd * alpha)) - 50))).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, i: F.struct((s["t"] * i / (nd - i + 1) * ((1 - alpha) / alpha)).alias("t"), (s["sum"] + s["t"] * i / (nd - i + 1) * ((1 - alpha) / alpha)).alias("sum"))
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), step, lambda s: s["sum"])
    # From the mode on the tail is about a half and more: no bound.
    return F.when((n <= 0) | (kd >= nd * alpha), F.lit(False)).otherwise(top + F.log(total) <= F.log(delta))


def fit_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(lang_group, cut): the last accepted step of the grid, null for none; a row for each group with a labelled good document.

    labels: (doc_id, quality); quality 1 marks the good documents.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = features.where("not base_failed").join(good, "doc_id", "left_semi").select("lang_group", "print", place().alias("place")).distinct()
    counts = held.groupBy("lang_group", "place").agg(F.count("*").alias("docs"))
    by_group = counts.groupBy("lang_group").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("place", "docs")).alias("at"))  # GRID_SIZE + 1 places at most
    groups = features.select("lang_group").distinct().agg(F.count("*").alias("groups"))
    # One row, so this adds a column.
    by_group = by_group.join(F.broadcast(groups), F.lit(True))
    share = F.lit(delta) / F.col("groups")
    grid = F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))
    rejected = lambda j: F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["place"] <= j, x["docs"]).otherwise(0))
    passed = F.transform(grid, lambda j: binomial_tail_within(F.col("n"), rejected(j), alpha, share))
    first_failed = F.coalesce(F.nullif(F.array_position(passed, False), F.lit(0).cast("long")), F.lit(GRID_SIZE + 1).cast("long"))
    return by_group.select("lang_group", F.nullif((first_failed - 2).cast("int"), F.lit(-1)).alias("cut"))


def apply_cutoffs(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with kept: false if a base rule or an accepted cutoff rejects."""
    # A row for each language group; Spark chooses the join by its size.
    found = features.join(cutoffs.select("lang_group", "cut"), "lang_group", "left")
    return found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(place() <= F.col("cut"), F.lit(False))).drop("cut")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Counts, rates, base_failed and kept for each row of docs (doc_id, text, lang)."""
    features = materialise(rule_features(docs), "rule-features")
    return apply_cutoffs(features, fit_cutoffs(features, labels, alpha, delta))
