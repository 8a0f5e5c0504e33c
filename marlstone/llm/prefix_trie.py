"""Conversation prefix trie: every distinct beginning of the conversations as a node, by burst tries.

A turn is the digest of its role and text, and a conversation is the string of its
turns' digests; texts aren't moved any further. Equal conversations become one sequence
first, with the number of its members and the hash of their ids, so a group of copies
weighs one row.

The trie's upper part consists of burst nodes, with containers of suffixes below them. It
starts as one container of all sequences under the root. A container that holds more
than ``container_turns`` turns, and more than one sequence, bursts by its next turn id
into a container for each. A round looks 1, 2, 4, ... turns ahead, so that
a long beginning that many conversations share takes few rounds. Containers that stay are
sorted, and a sweep over each makes the nodes below its head: neighbours' common turns
stay on the stack, what is left of them is done. Burst nodes are sums over the heads below
them.

Cases: null roles and texts are empty ones; turns without conv_id belong to no
conversation and are left out; turns of one number follow one another by digest, and
repeated rows are turns each; a null turn number comes first; a long text is hashed
whole; a conversation is one row of digests, 32 bytes for each turn; further columns
aren't read; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: Characters of a turn's digest.
WIDTH = 32
#: Conversations whose ids are joined into one string, by the higher bits of the id.
MEMBER_BITS = 12

_NODES = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
    + [("prefix", pa.string()), ("sizes", pa.list_(pa.int32()))]
)
_NODE_TYPES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, prefix string, sizes array<int>"
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests and sizes in bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", digest.alias("id"), F.octet_length(text).alias("n_bytes")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def branched(sequences: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations as branches: of conversation c - c % every the first crc32(c) % most turns, then c's own ones after as many."""
    base = F.col("conv_id") - F.col("conv_id") % every
    kept = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    trunks = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("trunk"))
    joined = sequences.withColumns({"base": base, "kept": kept}).join(trunks, "base", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("trunk", none), F.lit(1), F.col("kept")), F.slice("turns", F.col("kept") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _with_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence follow one another: one row, with the hash of all members' ids."""
    key, row, sha = None, None, None

    def done():
        return pa.RecordBatch.from_pylist([row | {"ends_sha256": sha.hexdigest()}], schema=_SEQUENCE)

    for batch in batches:
        made = []
        for r in batch.to_pylist():
            if r["key"] == key:
                row["n"] += r["n"]
                row["conv_id"] = min(row["conv_id"], r["conv_id"])
                sha.update(b",")
            else:
                if key is not None:
                    made.append(row | {"ends_sha256": sha.hexdigest()})
                key, row, sha = r["key"], {c: r[c] for c in ("key", "seq", "sizes", "conv_id", "n")}, hashlib.sha256()
            sha.update(r["members"].encode())
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_SEQUENCE)
    if key is not None:
        yield done()


_SEQUENCE = pa.schema([("key", pa.string()), ("seq", pa.string()), ("sizes", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])


def _distinct(sequences: DataFrame) -> DataFrame:
    """(key, seq, sizes, conv_id, n, ends_sha256): one row for all conversations of the same turns."""
    seq = F.array_join(F.col("turns")["id"], "")
    rows = sequences.select("conv_id", seq.alias("seq"), F.col("turns")["n_bytes"].alias("sizes"), F.md5(seq).alias("key"), F.shiftright("conv_id", MEMBER_BITS).alias("part"))
    members = F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("members")
    parts = rows.groupBy("key", "part").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), members)
    ordered = parts.repartition("key").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(_with_members, "key string, seq string, sizes array<int>, conv_id long, n long, ends_sha256 string")


def _node(seq: str, depth) -> F.Column:
    """The name of the node of a sequence's first turns."""
    return F.md5(F.substring(seq, F.lit(1), (depth * WIDTH).cast("int")))


def _burst(sequences: DataFrame, container_turns: int) -> DataFrame:
    """The sequences with ``depth``, that of their container's head, and ``at_burst``: the sequence ends at a burst node of that depth."""
    length = F.size("sizes")
    total = sequences.agg(F.sum(length + 1).alias("w"), F.count("*").alias("n")).first()
    start = sequences.withColumns({"depth": F.lit(0), "length": length})
    if total.n <= 1 or total.w <= container_turns:
        return start.withColumn("at_burst", F.lit(False)).drop("length")
    placed, pending, step = [], materialise(start, "trie-pending"), 1
    while True:
        placed.append(pending.where("length = depth").withColumn("at_burst", F.lit(True)))
        open_rows = pending.where("length > depth")
        levels = open_rows.select("key", "length", F.explode(F.sequence(F.col("depth") + 1, F.least(F.col("depth") + step, "length"))).alias("level"), "seq")
        levels = levels.select("key", "length", "level", _node("seq", F.col("level")).alias("node"))
        weight = F.sum(F.col("length") - F.col("level") + 1)
        over = materialise(levels.groupBy("node").agg(weight.alias("w"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("w") > container_turns)).select("node"), "trie-burst")
        deeper = levels.join(over, "node", "left_semi").groupBy("key").agg(F.count("*").cast("int").alias("burst"))
        marked = materialise(open_rows.join(deeper, "key", "left").withColumn("burst", F.coalesce("burst", F.lit(0))), "trie-marked")
        whole = F.col("burst") == F.least(F.lit(step), F.col("length") - F.col("depth"))  # every level looked at has burst
        placed.append(marked.where(~whole).withColumns({"depth": F.col("depth") + F.col("burst") + 1, "at_burst": F.lit(False)}).drop("burst"))
        pending, step = marked.where(whole).withColumn("depth", F.col("depth") + F.col("burst")).drop("burst"), step * 2
        if pending.isEmpty():
            break
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.drop("length")


class _Container:
    """Nodes of one container, of sequences that come in order."""

    def __init__(self, head: str, seq: str, depth: int, sizes: list[int]):
        self.head, self.top = head, depth
        self.prefix, self.above = seq[: depth * WIDTH], sizes[:depth]
        self.rows: list[list] = []  # conv_id, depth, parent's place, n_convs, n_children, n_leaves, saved_tokens, ends
        self.stack: list[tuple[int, int]] = []  # place, size of the last turn
        self.last = seq[: depth * WIDTH]
        self._push(depth, sizes[depth - 1] if depth else 0)

    def _push(self, depth: int, size: int) -> None:
        self.rows.append([None, depth, self.stack[-1][0] if self.stack else None, 0, 0, 0, 0, _NO_MEMBERS])
        self.stack.append((len(self.rows) - 1, size))

    def _pop(self) -> None:
        place, size = self.stack.pop()
        r = self.rows[place]
        r[5] = r[5] or 1
        r[6] += (r[3] - 1) * size
        if self.stack:
            up = self.rows[self.stack[-1][0]]
            up[0] = r[0] if up[0] is None else min(up[0], r[0])
            up[3], up[4], up[5], up[6] = up[3] + r[3], up[4] + 1, up[5] + r[5], up[6] + r[6]

    def add(self, seq: str, sizes: list[int], conv_id: int, n: int, ends: str) -> None:
        common, most = self.top, min(len(seq), len(self.last)) // WIDTH
        while common < most and seq[common * WIDTH : (common + 1) * WIDTH] == self.last[common * WIDTH : (common + 1) * WIDTH]:
            common += 1
        while len(self.stack) - 1 > common - self.top:
            self._pop()
        for d in range(common, len(sizes)):
            self._push(d + 1, sizes[d])
        r = self.rows[self.stack[-1][0]]
        r[0] = conv_id if r[0] is None else min(r[0], conv_id)
        r[3] += n
        r[7] = ends
        self.last = seq

    def nodes(self) -> Iterator[dict]:
        while self.stack:
            self._pop()
        for k, r in enumerate(self.rows):
            parent = None if r[2] is None else self.rows[r[2]][0]
            yield dict(zip(_NODES.names, (r[0], r[1], parent, *r[3:], self.prefix if k == 0 else None, self.above if k == 0 else None), strict=True))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose sequences follow one another in order."""
    container, made = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if container is None or r["head"] != container.head:
                if container is not None:
                    made += container.nodes()
                    if len(made) > 5_000:
                        yield pa.RecordBatch.from_pylist(made, schema=_NODES)
                        made = []
                container = _Container(r["head"], r["seq"], r["depth"], r["sizes"])
            container.add(r["seq"], r["sizes"], r["conv_id"], r["n"], r["ends_sha256"])
    if container is not None:
        made += container.nodes()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=_NODES)


def _levels(prefix: str, first, last) -> F.Column:
    """The nodes of a sequence from depth ``first`` to ``last``, with the size of each one's last turn."""
    size = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("sizes", j - 1))
    return F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("level"), _node(prefix, j).alias("node"), size(j).alias("size")))


def prefix_trie(sequences: DataFrame, container_turns: int = 1 << 14) -> DataFrame:
    """The nodes of (conv_id, turns), one row for each conversation.

    conv_id, the node's smallest member; depth; parent_conv_id; n_convs, its members;
    n_children; n_leaves, childless nodes in its subtree; saved_tokens, over its subtree
    the bytes of a node's last text times its members but one; ends_sha256, the hash of the
    ids of conversations that end here.
    """
    placed = materialise(_burst(materialise(_distinct(sequences), "trie-sequences"), container_turns), "trie-placed")
    suffixes = placed.where(~F.col("at_burst")).withColumn("head", _node("seq", F.col("depth")))
    swept = materialise(suffixes.repartition("head").sortWithinPartitions("head", "seq").select("head", "depth", "seq", "sizes", "conv_id", "n", "ends_sha256").mapInArrow(_sweep, _NODE_TYPES), "trie-swept")

    heads = swept.where(F.col("prefix").isNotNull() & (F.col("depth") > 0)).withColumn("depth", F.col("depth").cast("int"))
    below = heads.select("conv_id", F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"), F.col("depth"), "prefix", "sizes", F.explode(_levels("prefix", F.lit(0), F.col("depth") - 1)).alias("at"))
    ending = placed.where("at_burst").select("conv_id", "n", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.col("ends_sha256").alias("ends"), "depth", F.col("seq").alias("prefix"), "sizes", F.explode(_levels("seq", F.lit(0), F.col("depth"))).alias("at"))
    of_node = F.substring("prefix", F.lit(1), (F.col("at.level") * WIDTH).cast("int"))
    burst = below.unionByName(ending).select("conv_id", "n", "leaves", "saved", F.when(F.col("depth") == F.col("at.level"), F.col("ends")).alias("ends"), "at.*", of_node.alias("prefix"), F.slice("sizes", F.lit(1), F.col("at.level")).alias("sizes"))
    sums = [F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sizes").alias("sizes")]
    burst = materialise(burst.groupBy("node", "level").agg(*sums), "trie-burst-nodes")

    own = burst.select(((F.col("n_convs") - 1) * F.col("size")).alias("own"), F.explode(_levels("prefix", F.lit(0), F.col("level"))).alias("at")).groupBy(F.col("at.node").alias("node")).agg(F.sum("own").alias("own"))
    parents = heads.select(_node("prefix", F.col("depth") - 1).alias("node")).unionAll(burst.where("level > 0").select(_node("prefix", F.col("level") - 1).alias("node")))
    children = parents.groupBy("node").agg(F.count("*").alias("n_children"))
    named = burst.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = burst.join(own, "node", "left").join(children, "node", "left").withColumn("parent", F.when(F.col("level") > 0, _node("prefix", F.col("level") - 1))).join(named, "parent", "left")
    columns = [c for c in _NODES.names if c not in ("prefix", "sizes")]
    upper = upper.select("conv_id", F.col("level").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_MEMBERS)).alias("ends_sha256"))
    tops = heads.withColumn("parent", _node("prefix", F.col("depth") - 1)).drop("parent_conv_id").join(named, "parent", "left").withColumn("depth", F.col("depth").cast("long"))
    rest = swept.where(F.col("prefix").isNull() | (F.col("depth") == 0))
    return upper.select(columns).unionByName(tops.select(columns)).unionByName(rest.select(columns))


def conversation_trie(conversations: DataFrame, container_turns: int = 1 << 14) -> DataFrame:
    """The trie of branched conversations."""
    return prefix_trie(branched(turn_sequences(conversations)), container_turns)
