"""Operators against brute force, round trips and held-out labels."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import document, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import decontaminate, html_extract, licenses, packing, pii, setsketch, toxicity
from marlstone.llm.tokens import encoder
from marlstone.llm.training_order import feistel, write_training_order

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def brute_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1 .+@-()9é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_field_labels_counterparts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((k, f"{prose(k, 20)} call {phone} or {prose(k + 1, 5)} user.{k}@mail{k}.example.com {prose(k, 9)}"))
    rows.append((900, f"{prose(9, 9)} +1 (333) 555-1234 {prose(8, 9)} (333) 555-1234 then {prose(7, 9)} 12345 clean"))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = [(s.kind, rows[-1][1][s.start : s.end]) for s in got[900].spans]
    assert spans == [("phone", "+1 (333) 555-1234"), ("phone", "(333) 555-1234")]
    assert "<PHONE>" in got[900].redacted and "12345" in got[900].redacted
    assert all(len(got[k].spans) == 2 for k in range(300))


def exact_marginals(g, model):
    """Label probabilities by adding up all labellings."""
    n, labels = len(g.owner), model.chain.shape[0]
    out = np.zeros((n, labels))
    local = ((np.array(g.masks)[:, None] >> np.arange(pii.N_BITS)) & 1) @ model.node[:-1] + model.node[-1]
    for y in itertools.product(*[[c] if c else range(labels) for c in g.clamped]):
        score = sum(local[i, c] for i, c in enumerate(y) if not g.clamped[i]) + sum(model.chain[y[a], y[b]] for a, b in g.chain) + sum(model.skip[y[a], y[b]] for a, b in g.skip)
        out[np.arange(n), list(y)] += math.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_give_the_marginals():
    rng = np.random.default_rng(4)
    labels = len(pii.KINDS) + 1
    for loop in (False, True):
        for _ in range(12):
            skip = rng.normal(scale=0.5, size=(labels, labels))
            model = pii.FieldModel(rng.normal(size=(pii.N_BITS + 1, labels)) / 2, rng.normal(scale=0.5, size=(labels, labels)), skip + skip.T)
            g = pii.Graph([0] * 5, [(k, k + 1) for k in range(5)], rng.integers(0, 1 << pii.N_BITS, 5).tolist(), [0, 0, 2, 0, 0], [(0, 1), (1, 2), (3, 4)], [(0, 3)] + [(1, 4)] * loop)
            assert np.abs(pii.propagate(g, model) - exact_marginals(g, model)).max() < (0.12 if loop else 2e-3)


def test_skip_edges_carry_labels(spark):
    rng, rows = random.Random(6), []
    for k in range(300):
        phone, secret = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "".join(rng.choice("0123456789abcdef") for _ in range(40))
        again = phone if k % 3 == 0 else prose(k, 2)
        rows.append((k, f"{prose(k, 20)} call {phone} or {prose(k + 1, 5)} {again} {prose(k, 9)} token = \"{secret}\" {prose(k, 5)} {rng.randint(1, 99999)} {prose(k, 2)} {rng.randint(10**15, 10**16)}"))
    model = pii.fit_field(spark.createDataFrame(rows, "doc_id long, text string"))
    text = f"{prose(1, 9)} +1 (333) 555-1234 {prose(2, 9)} (333) 555-1234 then (444) 555-9876 and 77777 on"
    spans = lambda: [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_spans([text], model)[0][1]]
    assert spans() == [("phone", "+1 (333) 555-1234"), ("phone", "(333) 555-1234")]
    model.skip = np.zeros_like(model.skip)
    assert spans() == [("phone", "+1 (333) 555-1234")]


def test_secrets_and_decoys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pii.fit_field(docs)
    hex40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'See token = "{hex40}" here, and {hex40} there; not 12345 or 2024-01-05 or b2b.'
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_spans([text], model)[0][1]] == [("secret", hex40)] * 2
    assert pii.redact(text, pii.find_spans([text], model)[0][1]).count("<SECRET>") == 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = feistel(np.arange(n), n, 42)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 1000 or (slots != feistel(np.arange(n), n, 43)).any()


def test_shards_are_read_by_arithmetic(spark, tmp_path):
    texts = {k: prose(k, 3 * k + 1) if k % 9 else "" for k in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = write_training_order(docs, TOKENIZER, per_shard=16, row_ids=64, path=str(tmp_path)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    m = spark.read.json(str(tmp_path / "manifest")).first()
    n = m.sequences
    assert sorted({r.slot for r in rows}) == list(range(n)) and m.stride == 128 and m.per_shard == 16
    assert len(list(tmp_path.glob("shard-*.bin"))) == math.ceil(n / 16) and not list(tmp_path.glob("writing-*"))

    def read(slot):
        with open(tmp_path / f"shard-{slot // m.per_shard:08d}.bin", "rb") as f:
            f.seek(slot % m.per_shard * m.stride)
            return f.read(m.stride)

    seen = {k: 0 for k in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        raw = read(r.slot)
        assert len(raw) == m.stride and zlib.crc32(raw) == r.sequence_crc32 and r.start == seen[r.doc_id]
        assert np.frombuffer(raw, dtype=m.dtype)[r.offset : r.offset + r.length].tolist() == ids[r.doc_id][r.start : r.start + r.length]
        seen[r.doc_id] += r.length
    assert seen == {k: len(x) for k, x in ids.items()}
    # Of one partition at least, the sequences are neither in the order of the documents nor all in one shard.
    order = [r.slot for r in sorted(rows, key=lambda r: (r.doc_id, r.start))]
    assert order != sorted(order)


def test_another_corpus_is_refused(spark, tmp_path):
    docs = lambda seed: spark.createDataFrame([(k, prose(seed + k, 40)) for k in range(60)], "doc_id long, text string").coalesce(1)
    write = lambda df, folder="a", **more: write_training_order(df, TOKENIZER, per_shard=8, row_ids=32, path=str(tmp_path / folder), **more).collect()
    rows = write(docs(0))
    for other in (lambda: write(docs(500)), lambda: write(docs(0), key=3), lambda: write(docs(0).limit(59))):
        with pytest.raises(ValueError, match="another corpus"):
            other()
    assert sorted(map(tuple, write(docs(0)))) == sorted(map(tuple, rows))
    for folder, found in (("a", rows), ("b", write(docs(500), "b"))):
        for r in found:
            with open(tmp_path / folder / f"shard-{r.shard:08d}.bin", "rb") as f:
                f.seek(r.slot % 8 * 64)
                assert zlib.crc32(f.read(64)) == r.sequence_crc32
    # A folder whose writing was broken off has no manifest, and is finished by the same corpus.
    (tmp_path / "a" / "shard-00000000.bin").unlink()
    assert sorted(map(tuple, write(docs(0)))) == sorted(map(tuple, rows)) and (tmp_path / "a" / "shard-00000000.bin").exists()


def test_shards_written_again_stay(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(50)], "doc_id long, text string").coalesce(1)
    for _ in range(2):
        found = write_training_order(docs, TOKENIZER, per_shard=8, row_ids=32, path=str(tmp_path))
        assert found.count() > 0
        times = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("shard-*.bin")}
        assert found.count() > 0 and times == {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*.bin")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abCΣσİé'sre1 \n\t\x1c\x01.,!<|end́", max_size=40), max_size=4))
def test_ids_are_those_of_the_tokenizer(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    want = [plain.encode(t, add_special_tokens=False).ids for t in [*texts, "x<|endoftext|>y"]]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(TOKENIZER).encode([*texts, "x<|endoftext|>y"])] == want


def optimum(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit_enclose_the_optimum(sizes):
    x = np.array(sizes)
    bins, offsets, fills = packing.best_fit(x, 20)
    assert packing.lower_bound(x, np.ones(len(x), dtype=np.int64), 20) <= optimum(sorted(sizes, reverse=True), 20) <= len(fills)
    for b in range(len(fills)):
        own = sorted((o, s) for o, s, k in zip(offsets, sizes, bins, strict=True) if k == b)
        assert [o for o, _ in own] == [0, *itertools.accumulate(s for _, s in own)][:-1] and fills[b] == sum(s for _, s in own) <= 20


def test_packing_exchanges_gaps(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 2048)) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "uid long, length long").repartition(4)
    pieces = packing.materialise(pieces, "test-pieces")
    placed = packing.pack_pieces(pieces, per_bucket=200).join(pieces, "uid").collect()
    fill = Counter()
    for r in placed:
        fill[r.sequence_id] += r.length
    assert len(placed) == 3000 and max(fill.values()) <= 2048
    whole = packing.best_fit(np.array([s for _, s in rows]), 2048)[2]
    assert packing.packing_bound(pieces) <= len(fill) <= 1.02 * len(whole) + 1


def edit_distance_within(item, text):
    """The least distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 8))
def test_bit_vector_distance(item, text, most):
    want = edit_distance_within(item, text)
    got = decontaminate.distance_within(item, text, most)
    assert (got[0] if got else None) == (want if want <= most else None)


def edited(words, kind, share, rng):
    """words with a share of them edited."""
    n, w = max(1, int(share * len(words))), list(words)
    if kind == "first cut":
        return w[n:]
    if kind == "first replaced":
        return [f"zz{k}" for k in range(n)] + w[n:]
    for at in sorted(rng.sample(range(len(w)), n), reverse=True):
        w[at : at + 1] = {"replaced": [f"zz{at}"], "deleted": [], "inserted": [w[at], f"zz{at}"]}[kind]
    return w


@pytest.mark.parametrize("n", [15, 30, 60, 120, 200, 400])
def test_decontamination_recall(n):
    rng = random.Random(n)
    items = [(k, prose(1000 * n + k, n)) for k in range(40)]
    index = decontaminate.ItemIndex(items, 0.2)
    for kind in ("replaced", "deleted", "inserted", "first cut", "first replaced"):
        for share in (0.1, 0.18):
            docs = [" ".join([*prose(k, 50).split()[:20], *edited(text.split(), kind, share, rng), *prose(k + 77, 30).split()]) for k, text in items]
            got = index.matches(docs)
            assert sum(k in got[k] for k, _ in items) >= 36, (kind, share)
    assert all(got[k][k][0] == 0 for (k, _), got in zip(items, [index.matches([t for _, t in items])] * 40, strict=True))
    assert not any(index.matches([prose(5000 + k, 200) for k in range(50)]))


def with_edits(words, kind, n, rng):
    """words with exactly n edits."""
    w, filler = list(words), [f"zz{k}" for k in range(n)]
    middle = (len(w) - n) // 2
    if kind == "first cut":
        return w[n:]
    if kind == "last cut":
        return w[: len(w) - n]
    if kind == "middle replaced":
        return [*w[:middle], *filler, *w[middle + n :]]
    if kind == "middle cut":
        return [*w[:middle], *w[middle + n :]]
    kinds = {k: rng.choice(["replaced", "deleted", "inserted"]) if kind == "mixed" else kind for k in rng.sample(range(len(w)), n)}
    for at, one in sorted(kinds.items(), reverse=True):
        w[at : at + 1] = {"replaced": [f"zz{at}"], "deleted": [], "inserted": [w[at], f"zz{at}"]}[one]
    return w


@pytest.mark.parametrize("lengths", [range(a, a + 10) for a in range(10, 60, 10)])
def test_decontamination_recall_at_the_bound(lengths):
    """Every length and kind of edit, with all edits that the bound allows."""
    rng, low = random.Random(lengths[0]), {}
    for n in lengths:
        items = [(k, prose(10_000 * n + k, n)) for k in range(100)]
        index = decontaminate.ItemIndex(items, 0.2)
        for kind in ("replaced", "deleted", "inserted", "mixed", "first cut", "last cut", "middle replaced", "middle cut"):
            docs = [" ".join([*prose(k, 20).split(), *with_edits(text.split(), kind, n // 5, rng), *prose(k + 77, 30).split()]) for k, text in items]
            found = sum(k in got for (k, _), got in zip(items, index.matches(docs), strict=True))
            if found < 90:
                low[n, kind] = found
    assert not low


def test_contamination_is_that_of_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 40)))) for k in range(12)]
    texts = {}
    for k in range(60):
        w = [f"x{rng.randrange(50)}" for _ in range(30)]
        if k % 2:
            w[10:10] = edited(rng.choice(items)[1].split(), rng.choice(["replaced", "deleted", "inserted"]), 0.05, rng)
        texts[k] = " ".join(w)
    want = {(d, i): e for d, t in texts.items() for i, item in items if (e := edit_distance_within(item.split(), t.split())) <= math.floor(0.2 * len(item.split()))}
    rows = decontaminate.find_contamination(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got) and len(got) >= 0.9 * len(want) > 0
    for r in rows:
        assert edit_distance_within(dict(items)[r.item_id].split(), texts[r.doc_id][r.start : r.end].split()) == r.distance


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    from marlstone.llm.quality_rules import binomial_tail_within

    rows = [(n, k, d) for n in (0, 10, 500, 3000) for k in (0, 1, 3, 20) for d in (0.05, 0.002)]
    got = spark.createDataFrame(rows, "n long, k long, d double").withColumn("ok", binomial_tail_within(F.col("n"), F.col("k"), 0.01, F.col("d"))).collect()
    for r in got:
        tail = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(min(r.k, r.n) + 1))
        assert r.ok == (r.n > 0 and r.k < r.n * 0.01 and tail <= r.d), r


def test_sketch_estimates_and_merges():
    own = setsketch.seeds()
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**63, 2000, dtype=np.uint64)
    a, b = x[:1500], x[500:]
    ra, rb = setsketch.registers(a, own), setsketch.registers(b, own)
    assert (np.maximum(ra, rb) == setsketch.registers(x, own)).all()
    got = setsketch.estimate(ra[None], rb[None], np.array([1500.0]), np.array([1500.0]))[0]
    assert abs(got - 0.5) < 0.15


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    texts = {}
    for k in range(240):
        words = prose(k % 40 if k % 3 else k, 60).split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        texts[k] = " ".join(words) if k % 7 else prose(77, 60)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(texts, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    old = setsketch.LARGE
    for large in (64, 2):  # with and without the comparison of whole components
        setsketch.LARGE = large
        got = {r.doc_id: r for r in setsketch.near_duplicates(docs).collect()}
        assert all(got[k].component_id == root(k) and got[k].n_shingles == len(sets[k]) for k in texts)
    setsketch.LARGE = old


def in_buckets(spark, monkeypatch, buckets):
    """near_duplicates gets these buckets of documents; the first of each is its leader."""
    from pyspark.sql import functions as F

    rows = []
    for b, members in enumerate(buckets):
        hashes = spark.range(1000 * b, 1000 * (b + 1)).select(F.col("id").alias("key"), F.explode(F.array(*(F.lit(m).cast("long") for m in members))).alias("rep"))
        first = hashes.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("first")).where(F.col("first.rep") == members[0]).first()
        rows += [(first.key, m) for m in members]
    monkeypatch.setattr(setsketch, "_bands", lambda reps: spark.createDataFrame(rows, "key long, rep long"))


def test_strays_meet_components_that_grow_between_passes(spark, monkeypatch):
    own = lambda *spans: " ".join(f"w{k}" for a, b in spans for k in range(a, b))
    texts = {
        1: own((0, 100)), 2: own((0, 90), (200, 210)), 3: own((10, 110)), 4: own((20, 120)),
        5: own((0, 70), (200, 210), (300, 310), (400, 410)), 6: own((0, 70), (200, 210), (300, 310), (500, 510)), 7: own((0, 70), (200, 210), (300, 310), (600, 610)), 8: own((0, 80), (200, 210), (300, 310)),
    }
    # 4 is like 3 only, and 2 like 1 and 8: in the first pass 2 joins the large component of 5, and so does its own.
    in_buckets(spark, monkeypatch, [(1, 2, 3, 4), (5, 6, 7, 8, 2)])
    monkeypatch.setattr(setsketch, "LARGE", 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs, width=1).collect()} == dict.fromkeys(texts, 1)


def test_groups_of_strays_hold_two_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.group import GroupedData

    rng, texts = random.Random(3), {}
    for k in range(4):
        texts[k] = {*range(300, 395), *range(400 + 5 * k, 405 + 5 * k)}
    for k in range(4, 44):  # a template with fillings; each fourth is like the one before
        texts[k] = {*range(60), *rng.sample(range(1000, 9000), 40)} if k % 4 else {*sorted(texts[k - 1])[:95], *range(500 + 5 * k, 505 + 5 * k)}
    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {k: min(j for j in texts if like(texts[j], texts[k])) for k in texts}
    in_buckets(spark, monkeypatch, [tuple(texts)])
    monkeypatch.setattr(setsketch, "LARGE", 4)
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    sizes, old = [], GroupedData.applyInPandas

    def seen(self, *args):
        sizes.append(self.count().agg(F.max("count")).first()[0])
        return old(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", seen)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in sorted(t))) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs, width=1).collect()} == want
    assert len(sizes) == 2 and max(sizes) <= 30, sizes


def test_minimum_cut_is_least():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gain = rng.normal(size=n)
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda y: sum(max(0, -g) if v else max(0, g) for g, v in zip(gain, y, strict=True)) + sum(c for i, j, c in edges if y[i] != y[j])  # noqa: B023, E731
        assert math.isclose(cost(html_extract.minimum_cut(gain, edges)), min(map(cost, itertools.product((0, 1), repeat=n))), abs_tol=1e-6)


def test_page_text():
    page = """<html><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav><article><h1>A &amp; B</h1><p>First
      text.<p>Second text.<br>More.<div class="ad">Buy</div><script>var x='<p>'</script></article>
      <section class="comments"><p>Nice one, thanks for sharing it. Really.</p></section><footer>(c)</footer></body></html>"""
    assert html_extract.extract(page, html_extract.PRIOR)[0] == "A & B\n\nFirst text.\n\nSecond text. More."


def page_cost(page, weights, label):
    """The cost of a labelling of the whole page, from its features and edges."""
    gain = np.clip(html_extract.features(page) @ weights[:-1] + weights[-1], -html_extract.LARGEST, html_extract.LARGEST)
    return sum(max(0, -g) if v else max(0, g) for g, v in zip(gain, label, strict=True)) + sum(c for i, j, c in html_extract._edges(page) if label[i] != label[j])


def test_page_labels_are_those_of_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights, tried = html_extract.fit_blocks(pages), 0
    for r in pages.collect():
        for html in (r.html, re.sub(r"</?article[^>]*>|</?nav[^>]*>|</?footer[^>]*>| class=\"[^\"]*\"", " ", r.html)):
            page = html_extract.blocks_of(html)
            if len(page.blocks) <= 12 and tried < 30:
                label, tried = html_extract.labelled(page, weights)[0], tried + 1
                assert math.isclose(page_cost(page, weights, label), min(page_cost(page, weights, y) for y in itertools.product((0, 1), repeat=len(label))), abs_tol=1e-6)
    assert tried >= 10


def test_text_needs_no_names(spark, sf_dir, monkeypatch):
    """Fitted on every second page, held against the article's paragraphs of the others; clues are taken away step by step."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = html_extract.fit_blocks(pages.where("page_id % 2 = 0"))
    flows, old = [], html_extract._source_side
    monkeypatch.setattr(html_extract, "_source_side", lambda rest, *x: flows.append(len(rest)) or old(rest, *x))
    same, soup, blocks, changed = [0, 0], [0, 0], 0, 0
    for r in pages.where("page_id % 2 = 1").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = "\n\n".join(t for t, _ in html_extract.blocks_of(article).blocks)
        for k, html in enumerate((r.html, re.sub(r" (class|id|role)=\"[^\"]*\"", "", r.html))):
            same[k] += html_extract.extract(html, weights)[0] == want
        # No element or name tells anything.
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", re.sub(r" class=\"[^\"]*\"", "", r.html))
        page = html_extract.blocks_of(bare)
        label, alone = html_extract.labelled(page, weights)
        truth = np.array([t in want.split("\n\n") for t, _ in page.blocks], dtype=int)
        soup[0] += (label == truth).sum()
        soup[1] += (alone == truth).sum()
        blocks, changed = blocks + len(truth), changed + (label != alone).sum()
    n = pages.where("page_id % 2 = 1").count()
    assert same == [n, n]
    assert min(soup) >= 0.97 * blocks and changed > 0 and sum(flows) > 0, (soup, blocks, changed, sum(flows))
    # A paragraph that its own costs call boilerplate is held by its neighbours.
    html = "<div><a>x</a></div><div><h1>Title of it</h1>" + "".join(f"<p>{prose(k, 30)}.</p>" for k in range(3)) + "<p><a>ab</a></p>" + "".join(f"<p>{prose(k, 30)}.</p>" for k in range(3, 6)) + "</div>"
    label, alone = html_extract.labelled(html_extract.blocks_of(html), weights)
    assert label.tolist() == [0, *[1] * 8] and not alone[5]


def test_names_of_the_article_drop_nothing():
    text = [f"{prose(k, 40)}." for k in range(6)]
    for name in ("legal", "search", "related-work", "comments-on-policy", "post"):
        page = f"<nav><a>x</a></nav><main><article class='{name}'><h1>{prose(9, 5)}</h1>{''.join(f'<p>{t}</p>' for t in text)}</article></main><footer>f</footer>"
        assert html_extract.extract(page, html_extract.PRIOR)[0].split("\n\n")[1:] == text, name
    for holder in ("<div class='sidebar'>", "<div id='cookie-notice'>", "<section class='comments'>", "<aside>", "<form>"):
        page = f"<article><h1>{prose(9, 5)}</h1>{''.join(f'<p>{t}</p>' for t in text)}{holder}<p>Another text that is here, and goes on for some words.</p></article>"
        assert html_extract.extract(page, html_extract.PRIOR)[0].split("\n\n")[1:] == text, holder


def test_foreign_elements_drop_no_text():
    for page, want in (
        ("<svg class=icon /><article><p>One two.</p></article><svg><text>x</text></svg><p>Three.</p>", ["One two.", "Three."]),
        ("<p>a <math/>b</p><p>c <math><mi>x</mi></math> d</p>", ["a b", "c x d"]),
        ("<article><noscript>Shown.</noscript><object data=x>Instead.</object></article>", ["Shown.Instead."]),
        ("<p>a</p><svg><p>b</p>", ["a", "b"]), ("<p>a</p><math><mi>x</mi><p>b</p>", ["a", "x", "b"]), ("<p>a</p><object><p>b</p>", ["a", "b"]),
    ):
        assert [t for t, _ in html_extract.blocks_of(page).blocks] == want, page


def test_license_windows():
    index = licenses.Templates(licenses.LICENSES, 75)
    for name, text in licenses.LICENSES:
        got = index.scan(f"{prose(1, 300)}\n{text}\n{prose(2, 300)}")
        assert got[name][0] == 1.0
    assert index.scan(prose(3, 2000)) == {}


def test_toxicity_folds_and_excepts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = prose(k, 40).split()
        if toxic:
            words[rng.randrange(40)] = "wretchling"
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks, exceptions=("wretchling pie",))
    tests = [(1, f"{prose(9001, 30)} WRETCHLING {prose(9002, 9)}"), (2, f"{prose(9003, 30)} wr3tchl1ng {prose(9004, 9)}"), (3, f"{prose(9005, 30)} wrеtchling {prose(9006, 9)}"), (4, f"{prose(9007, 30)} wretchling pie {prose(9008, 9)}"), (5, prose(9009, 40))]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_hits_are_those_of_a_plain_scan():
    rng = random.Random(9)
    model = toxicity.ToxicityModel({" abc": 2.0, " ab ": 1.0, " dada": 3.0, " bad": 0.5}, ("abc cab", "bad dada"))
    phrases = [f" {p} " for p in model.exceptions]
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcd4") for _ in range(rng.randint(1, 5))) for _ in range(12))
        folded = toxicity.fold(text)
        covered = [(k, k + len(p)) for p in phrases for k in range(len(folded)) if folded.startswith(p, k)]
        counts = Counter(e for e in model.weights for k in range(len(folded)) if folded.startswith(e, k) and not any(a <= k and k + len(e) <= b for a, b in covered))
        total = sum(model.weights[e] * (1 + math.log(n)) for e, n in counts.items())
        got = toxicity.features(text, model.automaton())
        assert math.isclose(got[0], math.log1p(total)) and math.isclose(got[2], math.log1p(len(counts)))


def test_numbers_are_no_words():
    assert toxicity.fold("In 1990 l0ts of b4d 5 (2024) x9").split() == ["in", "lots", "of", "bad", "xg"]


def test_harmless_phrases_are_learned(spark):
    rng, rows, labels = random.Random(4), [], []
    for k in range(900):
        words = prose(k, 40).split()
        if k % 3 == 0:
            words[rng.randrange(40)] = "wretchling"
        elif k % 30 == 1:
            words[5:7] = ["wretchling", "pie"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), exceptions=())
    assert "wretchling pie" in model.exceptions


def test_good_documents_are_kept_jointly(spark):
    """Of fresh good documents, at most alpha goes by all rules together, in nearly all draws."""
    from marlstone.llm.quality_rules import quality_rules

    rng, rows, labels = random.Random(3), [], []
    for k in range(4000):
        words = prose(k, 60).split()
        for _ in range(int(rng.expovariate(1) * 3)):
            at = rng.randrange(60)
            words[at] = rng.choice([words[at].upper(), words[at] + "!", words[at] + "#"])
        rows.append((k, " ".join(words), "en"))
        labels += [(k, 1)] * (k < 2000)
    rows += [(5000 + k, rows[7][1], "en") for k in range(500)]  # copies are one draw
    labels += [(5000 + k, 1) for k in range(500)]
    found = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).where("not base_failed")
    kept = [r.kept for r in found.where("doc_id >= 2000 and doc_id < 5000").collect()]
    assert 0 < kept.count(False) <= 0.015 * len(kept)


def test_licenses_are_those_of_brute_force():
    index = licenses.Templates(licenses.LICENSES, 75)
    rng, hits = random.Random(2), 0
    for k in range(120):
        name, text = rng.choice(licenses.LICENSES)
        w = text.split()
        for _ in range(rng.randrange(1 + len(w) // 12)):
            w[rng.randrange(len(w))] = "zz"
        doc = f"{prose(k, rng.randint(0, 60))} {' '.join(w)} {prose(k + 500, 20)}"
        words = re.findall(r"\w+", doc.lower())
        want = set()
        for n, t in licenses.LICENSES:
            own = re.findall(r"\w+", t.lower())
            shingles = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            size = len(own) + max(1, len(own) // 2)
            starts = range(0, max(1, len(words)), max(1, len(own) // 2))
            if shingles and any(100 * len(shingles & {tuple(words[i : i + 5]) for i in range(a, min(a + size, len(words)) - 4)}) >= 75 * len(shingles) for a in starts):
                want.add(n)
        assert set(index.scan(doc)) == want, (name, doc)
        hits += bool(want)
    assert hits > 60


def test_quality_classifier_held_out(spark):
    from marlstone.llm.cotrain import fit_quality, score_quality

    rows, labels = [], []
    for k in range(800):
        bad = k % 5 == 0
        words = prose(k, 60).split()
        text = " ".join(f"{w}###" for w in words) if bad and k % 2 else " ".join([words[0]] * 60) if bad else " ".join(words)
        rows.append(document(k, text)[:5])
        labels.append((k, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in score_quality(docs, fit_quality(docs, marks.where("doc_id < 600"))).collect()}
    held = [(got[k], k % 5 != 0) for k in range(600, 800)]
    assert sum(a == b for a, b in held) >= 196


def mixed_quality(n, seed):
    """Documents whose quality shows in words and, mostly, in the source; ids, rows and labels."""
    rng, rows, labels = random.Random(seed), [], {}
    for k in range(n):
        bad = rng.random() < 0.4
        words = prose(seed * 100_000 + k, rng.randint(20, 60)).split()
        noisy = rng.random() < (0.9 if bad else 0.08)
        text = " ".join(f"{w}!" if noisy and rng.random() < 0.5 else w for w in words)
        source = f"host{rng.randint(0, 5)}" if rng.random() < 0.15 else f"{'junk' if bad else 'good'}{rng.randint(0, 2)}"
        rows.append((k, text, rng.choice(["en", "de", None]), source, len(text)))
        labels[k] = int(not bad)
    return rows, labels


def plain_rounds(rows, labels, rounds, per_round):
    """The rounds of co-training over all rows at once."""
    from marlstone.llm import cotrain as c

    by_id = {r[0]: r for r in rows}
    free = sorted(set(by_id) - set(labels))
    content = {k: np.float32(c.content_view(r[1])).astype(float) for k, r in by_id.items()}
    meta = {k: c._wide(np.float32([c.metadata_view(r[3], r[2], r[4])]).astype(float))[0] for k, r in by_id.items()}
    exact = {k: c.content_view(by_id[k][1]) for k in labels}, {k: c._wide(np.array([c.metadata_view(by_id[k][3], by_id[k][2], by_id[k][4])], dtype=float))[0] for k in labels}
    order = sorted(labels, key=lambda k: (labels[k], exact[0][k], k))
    own = [([exact[v][k] for k in order], [float(labels[k]) for k in order], [1.0] * len(order)) for v in (0, 1)]
    good, taken, given = np.mean(list(labels.values())), set(), []
    for _ in range(rounds):
        fitted = [c.logistic_fit(np.array(x), np.array(y), l2=1.0, weight=np.array(w)) for x, y, w in own]
        chosen = []
        for teacher, view in ((0, content), (1, meta)):
            p = {k: c.sigmoid(view[k] @ fitted[teacher][:-1] + fitted[teacher][-1]) for k in free if k not in taken}
            for label, most in ((0, max(1, int(per_round * (1 - good)))), (1, max(1, int(per_round * good)))):
                sure = sorted((round(float(q if label == 0 else 1 - q), 9), k) for k, q in p.items())
                chosen += [(teacher, label, k) for u, k in sure[:most] if u < 0.1]
        for teacher, label, k in chosen:
            x, y, w = own[1 - teacher]
            x.append((meta, content)[teacher][k])
            y.append(float(label))
            w.append(0.5)
        taken |= {k for *_, k in chosen}
        given += chosen
    return given, [c.logistic_fit(np.array(x), np.array(y), l2=1.0, weight=np.array(w)) for x, y, w in own]


def test_cotraining_rounds_are_those_of_a_plain_run(spark, monkeypatch):
    from marlstone.llm import cotrain

    rows, labels = mixed_quality(400, 3)
    marks = {k: labels[k] for k in range(0, 400, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    frame = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    given, surest = [], cotrain._surest
    monkeypatch.setattr(cotrain, "_surest", lambda *a: given.append(surest(*a)) or given[-1])
    model = cotrain.fit_quality(docs, frame, rounds=3, per_round=24)
    folds = dict(map(tuple, frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'quality'), 5)").collect()))
    free_or_train = [r for r in rows if r[0] not in marks or folds[r[0]] > 0]
    want, fitted = plain_rounds(free_or_train, {k: v for k, v in marks.items() if folds[k] > 0}, 3, 24)
    got = [(r["teacher"], r["label"], r["doc_id"]) for part in given for r in part]
    assert len(got) > 60 and sorted(got) == sorted(want)
    for mine, plain in ((model.content, fitted[0]), (model.metadata, fitted[1])):
        assert np.allclose(mine, plain, atol=1e-3)


def test_cotraining_helps_where_labels_are_few(spark):
    from marlstone.llm.cotrain import fit_quality, score_quality

    rows, labels = mixed_quality(1500, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(k, labels[k]) for k in range(60)], "doc_id long, quality int")
    loss = []
    for rounds in (0, 6):
        model = fit_quality(docs, marks, rounds=rounds, per_round=150)
        found = {r.doc_id: r for r in score_quality(docs, model).collect()}
        assert (model.combination[:-1] >= 0).all() and all(c[0] >= 0 for c in model.calibration)
        p = np.clip([[found[k].content_score, found[k].metadata_score, found[k].score] for k in range(60, 1500)], 1e-6, 1 - 1e-6)
        y = np.array([labels[k] for k in range(60, 1500)])[:, None]
        loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(axis=0))
    assert loss[1][2] < loss[0][2] and (loss[1][:2] < loss[0][:2]).any()


def test_a_view_without_signal_gets_no_weight():
    from marlstone.llm.cotrain import _not_negative

    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(float)
    a, b = 4 * (y - 0.5) + rng.normal(size=400), -0.5 * (y - 0.5) + rng.normal(size=400)
    found = _not_negative(np.stack([a, b], axis=1), y)
    assert found[0] > 1 and found[1] == 0
    assert _not_negative(-a[:, None], y)[0] == 0


def test_lists_and_cells_of_an_article_stay():
    prose_text = "These are the things that we read in the last year, all of them good."
    page = f"<body><nav><a>Home</a></nav><article><h1>Reading list</h1><p>{prose_text}</p><ul><li><a href=x>First link title</a></li><li><a href=y>Second</a></li></ul><table><tr><td>1</td><td>2</td></tr></table><p>That is all for now.</p></article><footer>Copyright</footer></body>"
    assert html_extract.extract(page, html_extract.PRIOR)[0].split("\n\n") == ["Reading list", prose_text, "First link title", "Second", "1", "2", "That is all for now."]


def test_the_cut_beats_single_blocks_without_clues(spark):
    """Pages without any names and elements that tell: fitted on one half, the cut is wrong less often than each block's own costs."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fitted = pages.where("page_id % 2 = 0")
    weights = html_extract.fit_blocks(fitted)
    capacities = html_extract.fit_capacities(fitted, weights)
    assert capacities in html_extract.CAPACITIES and sum(capacities) > 0
    wrong, changed = np.zeros(2, dtype=int), 0
    for row in pages.where("page_id % 2 = 1").collect():
        page = html_extract.blocks_of(row.html)
        truth = html_extract.labelled(page, weights, capacities)[0]
        bare = re.sub(r"</?(article|main|nav|footer|aside|header|section)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", re.sub(r"\s(class|id|role)=\"[^\"]*\"", "", row.html))
        stripped = html_extract.blocks_of(bare)
        if [t for t, _ in stripped.blocks] != [t for t, _ in page.blocks]:
            continue
        cut, alone = html_extract.labelled(stripped, weights, capacities)
        wrong += [int((cut != truth).sum()), int((alone != truth).sum())]
        changed += int((cut != alone).sum())
    assert changed > 0 and wrong[0] < wrong[1]
    assert html_extract.fit_capacities(pages.limit(0), weights) == (html_extract.SMOOTH, html_extract.SIBLING)
