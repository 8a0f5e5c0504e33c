"""Toxicity scores: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps compatibility forms and homoglyphs of other scripts to Latin
letters, digits within a word that stand for letters to these letters, and whatever is no
letter to a space; numbers stay numbers. Lexicon entries are word prefixes (or short whole words),
learned from labelled rows: those that toxic documents hold in significantly many
different contexts, so copies of a toxic document don't bring in its harmless words.
Weights are smoothed log-odds. Hits that lie within an exception phrase don't count:
phrases given by the caller, and word pairs with an entry that several harmless labelled
texts hold and no toxic one. Further hits of one entry count ever less. A logistic fit
turns the length-normalised sums into a probability.

Cases: a null or empty text scores as one without hits; repeated rows score
alike; a very long text is scanned whole; further columns aren't read; terms of equal significance are taken
longest first, then in the order of letters; an empty table gives an empty result; without
labelled rows of both classes the lexicon is empty and every score is the base rate (0 without rows).
Of a doc_id that is labelled and repeated with different texts, one text is learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import logistic_fit, materialise, sigmoid

# Letters of other scripts that look like Latin letters, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "rodeo clown", "pond scum", "soap scum")
PREFIXES = range(4, 9)
_NUMBER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])")


class _Fold(dict):
    """For str.translate: folds a character once and keeps it."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in c)
        if unicodedata.category(chr(code)) in ("Cf", "Mn"):  # zero-width and combining characters split no word
            out = ""
        else:
            out = "".join(x if x.isalpha() else " " for x in c) or " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text with one space before and after; words are separated by spaces."""
    return f" {_NUMBER.sub(' ', text).translate(_FOLD)} "


@dataclass
class ToxicityModel:
    """weights: log-odds by folded entry, with a leading space, and a trailing one if the whole word is meant."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    beta: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, -40.0])

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (0, len(entry), w, entry))
        for phrase in self.exceptions:
            key = " " + " ".join(fold(phrase).split()) + " "
            found.add_word(key, (1, len(key), 0.0, key))
        if len(found):
            found.make_automaton()
        return found


def features(text: str, automaton) -> tuple[float, float, float]:
    """Log of the weighted hits, hits by length, and distinct entries."""
    folded = fold(text)
    hits = list(automaton.iter(folded)) if len(automaton) else []
    if not hits:
        return 0.0, 0.0, 0.0
    covered = [(end - size + 1, end) for end, (kind, size, _, _) in hits if kind]
    counts: Counter = Counter()
    for end, (kind, size, w, entry) in hits:
        if not kind and not any(a <= end - size + 1 and end <= b for a, b in covered):
            counts[w, entry] += 1
    total = sum(w * (1 + math.log(n)) for (w, _), n in counts.items())
    words = folded.count(" ")
    return math.log1p(total), 10.0 * total / math.sqrt(100.0 + words), math.log1p(len(counts))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, by label, added up within the partition."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text).split())
            terms = {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}
            terms.update(f" {w} " for w in words if len(w) < PREFIXES[0])
            counts[toxic].update(terms)
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_pydict(
        {"term": pa.array(terms, pa.string()), "toxic_docs": pa.array([counts[1][t] for t in terms], pa.int64()), "other_docs": pa.array([counts[0][t] for t in terms], pa.int64())}
    )


def _g2(t: int, n: int, toxic: int, other: int) -> float:
    """The log-likelihood ratio of t toxic and n other documents against the shares among all; 0 if fewer are toxic than by chance."""
    share = toxic / (toxic + other)
    if not t or t <= (t + n) * share:
        return 0.0
    part = lambda c, p: c * math.log(c / ((t + n) * p)) if c else 0.0
    return 2 * (part(t, share) + part(n, 1 - share))


def _pick(rows: list, toxic: int, other: int, size: int, least: float) -> dict[str, float]:
    """Entries, most significant first, without those that an entry already covers; of equal ones the longest.

    rows: (term, toxic_docs, other_docs, contexts in toxic documents).
    """
    scored = []
    for term, t, n, contexts in rows:
        weight = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((n + 0.5) / (other - n + 0.5))
        scored.append((-_g2(min(t, contexts), n, toxic, other), -len(term), term, weight))
    picked: dict[str, float] = {}
    for g2, _, term, weight in sorted(scored):
        if -g2 < least or len(picked) >= size:
            break
        if not any(term[:n] in picked for n in range(2, len(term))) and not any(p.startswith(term) for p in picked):
            picked[term] = weight
    return picked


def _contexts(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, before): the words before each candidate term in toxic documents."""
    wanted = set(terms)
    for batch in batches:
        found = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            before = ""
            for w in fold(text).split() if toxic else ():
                for term in [f" {w[:n]}" for n in PREFIXES if len(w) >= n] or [f" {w} "]:
                    if term in wanted:
                        found.add((term, before))
                before = w
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["term", "before"])


def _phrases(batches: Iterator[pa.RecordBatch], entries: set[str]) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic): word pairs of each text with a word that an entry matches."""
    for batch in batches:
        found = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = fold(text).split()
            hit = [f" {w} " in entries or any(f" {w[:n]}" in entries for n in PREFIXES if len(w) >= n) for w in words]
            found += sorted({(f"{words[k]} {words[k + 1]}", toxic) for k in range(len(words) - 1) if hit[k] or hit[k + 1]})
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["phrase", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, lexicon_size: int = 2_000, exceptions: tuple[str, ...] = EXCEPTIONS, least_weight: float = 3.0, least_harmless: int = 5) -> ToxicityModel:
    """Learn entries and weights from labelled rows.

    ``labels`` (doc_id, toxic) are the rows to learn from; at most ``max_labelled``
    of them, by a hash of doc_id, are used, each text once. At most ``lexicon_size`` entries
    are kept, each of log-odds ``least_weight`` at least and significant after correction for
    the number of terms tried. A word pair of ``least_harmless`` harmless texts and no toxic one
    is an exception; at most ``lexicon_size`` of them are kept, the most frequent ones.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.where("toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of two numbers are broadcast.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialise(sample, "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return ToxicityModel(exceptions=exceptions, beta=[0.0, 0.0, 0.0, 40.0 if toxic else -40.0])
    terms = sample.mapInArrow(_terms, "term string, toxic_docs long, other_docs long").groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs"))
    terms = terms.where("toxic_docs + other_docs >= 3")
    t, o = F.col("toxic_docs").cast("double"), F.col("other_docs").cast("double")
    share = toxic / (toxic + other)
    part = lambda c, p: F.when(c > 0, c * F.log(c / ((t + o) * p))).otherwise(0.0)
    terms = materialise(terms.withColumn("g2", 2 * (part(t, share) + part(o, 1 - share))).where(t > (t + o) * share), "toxicity-terms")
    tried = max(terms.count(), 1)
    least = 2 * math.log(tried) + 3
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((o + 0.5) / (other - o + 0.5))
    # A bounded collect; the best entries are among ten times as many, with prefixes of one another.
    rows = terms.where((F.col("g2") >= least) & (odds >= least_weight)).orderBy(F.desc("g2"), "term").limit(10 * lexicon_size).collect()
    names = [r["term"] for r in rows]
    contexts = sample.mapInArrow(lambda batches: _contexts(batches, names), "term string, before string").distinct().groupBy("term").agg(F.count("*").alias("n"))
    of = {r["term"]: r["n"] for r in contexts.collect()} if names else {}
    model = ToxicityModel(_pick([(r["term"], r["toxic_docs"], r["other_docs"], of[r["term"]]) for r in rows], toxic, other, lexicon_size, least), exceptions)
    entries = set(model.weights)
    pairs = sample.mapInArrow(lambda batches: _phrases(batches, entries), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    harmless = pairs.where(f"toxic = 0 and n >= {least_harmless}").orderBy(F.desc("n"), "phrase").limit(lexicon_size).collect()
    model.exceptions = (*exceptions, *(r["phrase"] for r in harmless))
    got = np.array([tuple(r) for r in _with_features(sample, model).select("x0", "x1", "x2", "toxic").collect()])
    model.beta = logistic_fit(got[:, :3], got[:, 3], l2=0.5).tolist()
    return model


def _with_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with x0, x1, x2 (double); every column but text is kept."""
    fields = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            xs = np.array([features(t or "", automaton) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(xs[:, k]) for k in range(3)], names + ["x0", "x1", "x2"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["x0 double", "x1 double", "x2 double"])
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text)."""
    found = _with_features(docs.select("doc_id", "text"), model)
    b = [float(x) for x in model.beta]
    z = F.lit(b[3]) + b[0] * F.col("x0") + b[1] * F.col("x1") + b[2] * F.col("x2")
    z = F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))
    score = 1 / (1 + F.exp(-z))
    return found.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def base_rate(model: ToxicityModel) -> float:
    return float(sigmoid(model.beta[-1]))
