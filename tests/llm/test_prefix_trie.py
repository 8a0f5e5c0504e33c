"""The prefix trie against a plain one, with containers of several sizes."""

import hashlib
import random
import zlib

import pytest

from marlstone.llm.prefix_trie import branched, conversation_trie, prefix_trie, turn_sequences

SCHEMA = "conv_id long, turn long, role string, text string, prefix string, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_conversations(rows):
    """conv_id -> [(role, text)], rebuilt."""
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - c % 5, [])[: head(c)] + turns[head(c) :] for c, turns in own.items()}


def plain_trie(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(conversations[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves[p], saved[p], ends(p)) for p in members)


def nodes(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    trunk = [("user" if k % 2 == 0 else "assistant", f"shared {k} é") for k in range(40)]
    made = []
    for c in range(90):
        if c % 3 == 0:  # copies and near copies of a long conversation
            turns = trunk[: rng.choice([40, 40, 39, 20, 33])] + ([("user", f"own {rng.randint(0, 3)}")] if rng.random() < 0.5 else [])
        else:
            turns = [(rng.choice(["user", "system"]), rng.choice("ab")) for _ in range(rng.randint(1, 6))]
        made += [(c, k, r, t, "x", 1) for k, (r, t) in enumerate(turns)]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("container_turns", [1, 60, 100_000])
def test_trie_equals_plain(spark, rows, container_turns):
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(conversation_trie(df, container_turns)) == plain_trie(plain_conversations(rows))


def test_unbranched_and_members_of_many_parts(spark):
    rows = [(c, 0, "user", "same", "x", 1) for c in [*range(0, 30_000, 1_000), 5]] + [(7, 0, "user", "same", "x", 1), (7, 1, "user", "more", "x", 1)]
    conversations = {c: [("user", "same")] for c in [*range(0, 30_000, 1_000), 5]} | {7: [("user", "same"), ("user", "more")]}
    for container_turns in (1, 1_000):
        assert nodes(prefix_trie(turn_sequences(spark.createDataFrame(rows, SCHEMA)), container_turns)) == plain_trie(conversations)


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None, None, None), (1, 2, "user", "two", "x", 1), (1, 1, None, "one", "x", 1), (2, 0, "user", "long " * 50_000, "x", 1), (2, 0, "user", "tie", "x", 1), (2, 0, "user", "tie", "x", 1),
        (None, 0, "user", "nobody's", "x", 1), (3, 0, "", "", "x", 1), (6, 0, "user", "a:", "x", 1), (7, 0, "user", "", "x", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_trie(plain_conversations(rows))
    assert nodes(conversation_trie(df)) == nodes(conversation_trie(df, 1)) == want
    assert nodes(conversation_trie(df.limit(0))) == []
    assert branched(turn_sequences(df)).count() == 5


def test_turnless_conversation(spark):
    rows = [(c, 0, "user", "only", "x", 1) for c in range(1, 5)]  # conversation 0 is absent
    assert () in plain_conversations(rows).values() or [] in plain_conversations(rows).values()
    assert nodes(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(plain_conversations(rows))
