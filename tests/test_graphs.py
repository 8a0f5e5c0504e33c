"""Subtrees, similarity joins and the neighbour index, against plain versions."""

import random
from collections import Counter, defaultdict, deque
from difflib import SequenceMatcher

import numpy as np
import pytest

from marlstone.functions.text import trigrams
from marlstone.operators import knn, neighbours
from marlstone.operators.graph import descend, occupation_graph
from marlstone.operators.lookup import best_trigram_match, resolve
from marlstone.operators.neighbours import indexed_groups, neighbour_graph
from marlstone.operators.postings import clustered_roles
from marlstone.operators.similarity import candidate_pairs, held_pairs, letters, similar_pairs
from marlstone.plans import graphs, texts


def plain_descent(edges, seeds):
    below = defaultdict(set)
    for child, parent in edges:
        if child is not None and parent is not None:
            below[parent].add(child)
    out = {}
    for seed in seeds:
        queue = deque([(seed, 0)])
        while queue:
            node, depth = queue.popleft()
            if (seed, node) not in out:
                out[seed, node] = depth
                queue += [(c, depth + 1) for c in below[node]]
    return out


def test_descend_with_cycles_loops_and_nulls(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(90)] + [(f"c{k + 1}", f"c{k}") for k in range(25)] + [("c0", "c25"), ("n1", "n1"), (None, "n1"), ("n2", None)]
    seeds = ["n1", "n5", "c3", "alone", "n1"]
    got = descend(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([(s,) for s in seeds] + [(None,)], "seed string")).collect()
    assert {(r.seed, r.node): r.depth for r in got} == plain_descent(edges, set(seeds)) and len(got) == len(plain_descent(edges, set(seeds)))


def test_descend_of_nothing(spark):
    none = spark.createDataFrame([], "child long, parent long")
    assert descend(none, spark.createDataFrame([], "seed long")).count() == 0
    assert [tuple(r) for r in descend(none, spark.createDataFrame([(4,)], "seed long")).collect()] == [(4, 4, 0)]


def test_occupation_graph(spark):
    # job <- dev <- (web, data); data has a second parent that is no job; org is a class of organisations below dev.
    edges = [("dev", "job"), ("web", "dev"), ("data", "dev"), ("data", "science"), ("org", "dev"), ("clerk", "org"), ("clerk", "dev"), ("web", "web"), ("cook", "job")]
    skills = [("web", "html"), ("web", " css "), ("web", "Q42"), ("data", ""), ("data", "sql"), ("cook", "knife"), ("org", "money")]
    labels = [("web", "web developer"), ("data", ""), ("dev", "developer"), ("web", "webmaster")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = occupation_graph(frame(edges, "child string, parent string"), frame([("dev",), ("web",)], "seed string"), "job", frame(skills, "node string, skill string"), frame(labels, "node string, label string"), dropped=("org",))
    assert sorted((r.node, r.label, r.related, r.skills) for r in got.collect()) == [
        ("clerk", "clerk", ["dev"], []),
        ("data", "data", ["dev"], ["sql"]),
        ("dev", "developer", ["job"], []),
        ("job", "job", [], []),
        ("web", "web developer", ["dev"], ["css", "html"]),
    ]


def plain_trigrams(s):
    s = f"  {s.lower()} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def made_names(seed, n):
    rng = random.Random(seed)
    parts = ["data", "engineer", "scientist", "senior", "web", "developer", "ml", "ops", "react", "cloud", "site", "analyst", "product", "manager"]
    names = [" ".join(rng.sample(parts, rng.randint(1, 4))) for _ in range(n)]
    spoil = lambda s: "".join(c for c in s if rng.random() > 0.08) + rng.choice(["", "", "s", "x"])
    return [x for x in dict.fromkeys(names + [spoil(s) for s in names]) if x.strip()]


@pytest.mark.parametrize("t", [0.9, 0.6, 0.3])
def test_similar_pairs_are_those_of_all_pairs(spark, t):
    names = made_names(2, 120)
    df = spark.createDataFrame([(x,) for x in names], "l string").select("l", trigrams("l").alias("items"))
    jac = lambda a, b: len(a & b) / len(a | b)
    sets = {x: plain_trigrams(x) for x in names}
    want = {(x, y) for x in names for y in names if jac(sets[x], sets[y]) >= t - 1e-9}
    other = df.withColumnRenamed("l", "r")
    assert {(r.l, r.r) for r in similar_pairs(df, other, t).collect()} == want
    candidates = candidate_pairs(df, other, t).count()
    shared = sum(bool(sets[x] & sets[y]) for x in names for y in names)
    assert len(want) <= candidates < shared
    if t == 0.9:
        assert candidates < shared / 15


def test_letters_bound_the_sequence_ratio(spark):
    names = made_names(3, 60)
    df = spark.createDataFrame([(x,) for x in names], "l string").select("l", letters("l").alias("items"))
    got = {(r.l, r.r) for r in candidate_pairs(df, df.withColumnRenamed("l", "r"), 0.8 / 1.2).collect()}
    assert {(x, y) for x in names for y in names if SequenceMatcher(None, x, y).ratio() >= 0.8} <= got
    assert {r.l: sorted(r["items"]) for r in df.where("l = 'data'").collect()} in ({}, {"data": ["a0", "a1", "d0", "t0"]})


def test_held_pairs(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    left, right = names[:80], names[70:]
    want = {(x, y) for x in left for y in right if len(x) >= 4 and (x in y or y in x)}
    got = held_pairs(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"))
    assert {(r.l, r.r) for r in got.collect()} == want


def plain_similarity(q, a):
    part = lambda x, y: len(x & y) / len(x | y)
    best = max(SequenceMatcher(None, q, a).ratio(), part(plain_trigrams(q), plain_trigrams(a)), part(set(q.split()), set(a.split())))
    return max(best, 0.8) if len(q) >= 4 and (q in a or a in q) else best


def test_resolve_equals_all_pairs(spark):
    aliases = [(a, k % 23) for k, a in enumerate(made_names(5, 60)) if "senior" not in a] + [("abcd", 50), ("zzacq", 51)]
    asked = [q for q in made_names(6, 40) if "senior" not in q] + ["acbd", "q", "zzzzzz"]
    got = {r["query"]: r for r in resolve(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(aliases, "alias string, id long")).collect()}
    assert set(got) == set(asked)
    for q in asked:
        less, best = min((-plain_similarity(q, a), i) for a, i in aliases)
        exact = [i for a, i in aliases if a == q]
        if exact:
            assert got[q].id == min(exact) and got[q].tier == "exact" and got[q].score == 1.0
        elif -less >= 0.3:
            assert (got[q].id, round(got[q].score, 9), got[q].tier) == (best, round(-less, 9), "fuzzy"), q
        else:
            assert got[q].id is None and got[q].score == 0 and got[q].confidence == "low"
    assert got["acbd"].id == 50 and got["acbd"].confidence == "med"


def test_best_trigram_match_equals_all_pairs(spark):
    names, others = made_names(7, 50), made_names(8, 50)
    rows = best_trigram_match(spark.createDataFrame([(x,) for x in [*names, "0123"]], "name string"), "name", spark.createDataFrame([(x,) for x in others], "other string"), "other").collect()
    jac = lambda x, y: len(plain_trigrams(x) & plain_trigrams(y)) / len(plain_trigrams(x) | plain_trigrams(y))
    want = {x: min((-round(jac(x, y), 6), y) for y in others) for x in names}
    assert {r.name: (-r.similarity, r.other) for r in rows} == {x: v for x, v in want.items() if v[0] < 0}


def test_trigram_resolution_reads_whole_names(spark, tmp_path):
    """Names that differ in the first letter only are two, and what lies behind 1,000 letters counts."""
    long = "".join(random.Random(3).choices("abcdefgh", k=1200))
    names = ["bolt", "colt", "bolts", long, long[:1100], long[:1000] + "x" * 100, "Bolt", None]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.name: (-r.similarity, r.candidate) for r in texts.trigram_resolution(spark, str(tmp_path)).collect()}
    jac = lambda x, y: len(plain_trigrams(x) & plain_trigrams(y)) / len(plain_trigrams(x) | plain_trigrams(y))
    assert got == {x: min((-round(jac(x, y), 6), y) for y in names if y and y != x) for x in names if x}


def unit_rows(seed, n, dim=64):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_mates(x, cosine, seed):
    noise = unit_rows(seed, len(x), x.shape[1])
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * noise


def test_recall_of_the_index(spark):
    x = unit_rows(1, 3000)
    x = np.vstack([x, with_mates(x, 0.75, 2)]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>").repartition(4)
    got = neighbour_graph(df, "id", "v", k=4, least=0.7, cells=64)
    found = {(r.id, r.neighbour) for r in got.collect()}
    want = [(k, k + 3000) for k in range(3000)]
    recall = sum(p in found for p in want) / 3000
    assert recall >= 0.9 and all((b, a) in found for a, b in want if (a, b) in found)
    compared = df.count() * 2 * 64**0.45 / 64
    assert compared < df.count() / 3  # rows that each one meets, of all


def test_vector_neighbours_are_those_of_all_pairs(spark, tmp_path, monkeypatch):
    """Far neighbours, many cells' worth of rows, copies, and a similarity whose sixth digit is a five below the half."""
    monkeypatch.setattr(knn, "TILE", 256)
    monkeypatch.setattr(knn, "LARGEST", 1500)
    x = unit_rows(7, 3000, 16).astype(np.float32)
    x[100:140] = x[7]
    x[2999] = 0
    x = np.vstack([np.hstack([x, np.zeros((3000, 2), dtype=np.float32)]), np.zeros((2, 18), dtype=np.float32)])
    x[3000, 16], x[3001, 16:] = 1, (0.32785, np.sqrt(1 - 0.32785**2))
    spark.createDataFrame([*((k, v.tolist()) for k, v in enumerate(x)), (9000, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-12)
    near = np.round(unit @ unit.T, 6)
    np.fill_diagonal(near, -2)
    order = np.argsort(-near, axis=1, kind="stable")[:, :8]
    want = {(a, int(b), r + 1): near[a, b] for a in range(len(x)) for r, b in enumerate(order[a]) if near[a, b] >= 0.3}
    got = {(r.vec_id, r.neighbour, r["rank"]): r.similarity for r in graphs.vector_neighbours(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 6e-5 for p in want)
    assert got[3000, 3001, 1] == np.floor(0.32785 * 10_000 + 0.5) / 10_000 == 0.3278


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    centres = unit_rows(3, 40, 16)
    rng = np.random.default_rng(4)
    x = np.vstack([c + rng.normal(size=(rng.integers(1, 60), 16)) * 0.04 for c in centres] + [np.tile(centres[0], (300, 1))]).astype(np.float32)
    block = ["a" if k % 2 else "b" for k in range(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & (np.array(block)[:, None] == np.array(block)[None, :])
    label = np.arange(len(x))
    while not np.array_equal(now := np.where(near, label[None, :], len(x)).min(axis=1), label):
        label = now
    rows = [(k, v.tolist(), b) for k, (v, b) in enumerate(zip(x, block, strict=True))]
    df = spark.createDataFrame([*rows, (9000, None, "a"), (9001, [0.0] * 16, "a"), (9002, [], "b")], "id long, v array<float>, block string").repartition(3)
    for cells in (1, 24):
        got = {r.id: r.group for r in indexed_groups(df, "id", "v", 0.9, ["block"], cells=cells).collect()}
        assert got == {**dict(enumerate(label.tolist())), 9000: 9000, 9001: 9001, 9002: 9002}
    assert indexed_groups(df.limit(0), "id", "v").count() == 0 and neighbour_graph(df.limit(0), "id", "v").count() == 0


def test_clustered_roles(spark):
    centres = unit_rows(5, 3, 8)
    rng = np.random.default_rng(6)
    titles = [["Senior Data Engineer", "Data Engineer II", "ETL Developer"], ["Web Developer", "Lead Web Developer"], ["Senior", None]]
    rows, members = [], defaultdict(list)
    for k in range(240):
        c = k % 3
        market = "IN" if k % 4 else ("US" if k % 8 else None)
        title = rng.choice(titles[c])
        rows.append((k, market, title, (centres[c] + rng.normal(size=8) * 0.01).tolist()))
        members[market, c].append(title or "")
    got = clustered_roles(spark.createDataFrame(rows, "id long, market string, title string, v array<double>"), "id", "market", "title", "v", floor=40, least=0.9).collect()
    assert sorted((r.market, r.posting_count) for r in got) == sorted((m, len(t)) for (m, c), t in members.items() if m == "IN")
    by_label = {r.label_title: r for r in got}
    assert by_label["Web Developer"].role_id == "derived:in:web-developer" and by_label["Web Developer"].member_titles == '["Lead Web Developer","Web Developer"]'
    counts = Counter("etl developer" if t == "ETL Developer" else "data engineer" for t in members["IN", 0])
    assert counts.most_common(1)[0][0].title() in {k.title() for k in by_label}
