"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from marlstone.llm import collocations as module
from marlstone.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, rank int"


def plain(rows, least=30, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if 2 <= len(p) and c >= least}
        inside = defaultdict(int)
        for p, c in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], c)
        scored = []
        for p, a in frequent.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def made_rows(seed=1, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a\x1cb", "new", "york", "city", "x-y", "in", "漢字", "'s"]
    runs = ["New York city hall", "of the", "in the city of", "a b c d e", "one two three four five"]
    made = []
    for _ in range(n):
        parts = [rng.choice(runs) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        made.append(("".join(p + rng.choice([" ", " ", "\t", "  ", " ", ". ", "\n", ";", "\x0b"]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return made


@pytest.mark.parametrize(("chunk", "most"), [(8 << 20, 2000), (2_000, 2000), (2_000, 3)])
def test_equals_plain(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(module, "CHUNK", chunk)  # tasks of a local session see the driver's value only where they are forked from it
    monkeypatch.setattr(module, "PART", 50 if chunk == 2_000 else 1 << 20)
    rows = made_rows()
    df = spark.createDataFrame([(k, t, lang, "x", 1, 1) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations(df, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, most=most)


def test_chunks_of_a_task(monkeypatch):
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(module.TaskContext, "get", staticmethod(lambda: Task))
    monkeypatch.setattr(module, "CHUNK", 50)
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": "some words here and Some words"} for lang in "abab"])
    rows = [r for b in module._first_level(iter([batch])) for r in b.to_pylist()]
    assert len({r["chunk"] for r in rows}) == len(rows) == 4 and [r["words"] for r in rows] == [6] * 4
    assert dict(zip(module._unpacked_texts(rows[0]["phrases"]).to_pylist(), module._unpacked(rows[0]["counts"]).tolist(), strict=True)) == {"some": 2, "words": 2, "here": 1, "and": 1}
    for parts in (1, 3, 1000):
        dealt = [r for b in module._dealt(parts)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
        assert sum(len(module._unpacked(r["ids"])) for r in dealt) == sum(r["n"] for r in rows) and all(r["part"] < parts for r in dealt)
        where = {}
        for r in dealt:
            for p in module._unpacked_texts(r["phrases"]).to_pylist():
                assert where.setdefault(p, r["part"]) == r["part"]


def test_odd_texts(spark, odd_docs):
    long_text = "very long text " * 20_000
    rows = [(None, "en"), ("", "en"), (" \n\t ", None), ("!?.", "en"), ("lone", "en"), (long_text, None), *[("some words of it", "en")] * 31, *[("tie one. tie two", "fr")] * 30]
    df = spark.createDataFrame([(k, t, lang, "x", 1, 1) for k, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in collocations(df).collect()) == plain(rows)
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df.where("doc_id < 5")).count() == 0
    assert collocations(odd_docs).count() == len(plain([(r.text, r.lang) for r in odd_docs.collect()]))


def test_rare_pairs_are_not_written(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randrange(300)}" for _ in range(60)) + ". New York city hall", "en") for _ in range(500)]
    df = spark.createDataFrame([(k, t, lang, "x", 1, 1) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    written = {}
    monkeypatch.setattr(module, "materialise", lambda df, name, old=module.materialise: written.setdefault(name, old(df, name)))
    found, _ = module.frequent_phrases(df)
    assert {r.phrase: (r.k, r.f) for r in found.where("k > 1").collect()} == {p: (len(p.split()), 500) for p in ("new york", "york city", "city hall", "new york city", "york city hall", "new york city hall")}
    # Three chunks have three frequent pairs each, and about 9,000 others.
    assert [9 <= written["occurrences-2"].agg({"n": "sum"}).first()[0] < 100, written["occurrences-4"].agg({"n": "sum"}).first()[0]] == [True, 3]


@pytest.mark.parametrize(("slots", "part"), [(0, 2_000), (0, 50), (1, 2_000)])
def test_phrases_that_share_slots(spark, monkeypatch, slots, part):
    monkeypatch.setattr(module, "SLOTS", slots)
    monkeypatch.setattr(module, "SLOT_PART", part)
    rows = made_rows(2)
    df = spark.createDataFrame([(k, t, lang, "x", 1, 1) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in collocations(df).collect()) == plain(rows)
    assert sorted(tuple(r) for r in collocations(df, least=300).collect()) == plain(rows, least=300)


def test_slots_of_a_chunk(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(module.TaskContext, "get", staticmethod(lambda: Task))
    rng = random.Random(6)
    text = " ".join(f"w{int(rng.paretovariate(0.5)) % 30_000}" for _ in range(200_000))
    [row] = [r for b in module._first_level(iter([pa.RecordBatch.from_pylist([{"lang": "en", "text": text}])])) for r in b.to_pylist()]
    for parts, width in ((1, 400_000), (7, 60_000), (300_000, 1)):
        rows = [r for b in module._slotted(parts, width, 30)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
        slots = [np.cumsum(module._unpacked(r["slots"])) for r in rows]
        assert len({r["part"] for r in rows}) == len(rows) and all(r["part"] < parts and 0 <= s.min() and s.max() < width for r, s in zip(rows, slots, strict=True))
        counts = np.concatenate([module._unpacked(r["counts"]) for r in rows])
        where = np.concatenate([s + r["part"] * width for r, s in zip(rows, slots, strict=True)])
        true_slots, true_counts = np.unique(module._joined(row, parts * width)[-1], return_counts=True)
        assert where.tolist() == true_slots.tolist() and counts.tolist() == np.minimum(true_counts, 30).tolist() and true_counts.sum() == 199_999
        if parts == 1:  # fewer bytes than the pairs as text
            words = text.split()
            texts = module._packed_texts(pa.array(sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})))
            assert sum(len(r["slots"]) + len(r["counts"]) for r in rows) < 0.7 * len(texts)
