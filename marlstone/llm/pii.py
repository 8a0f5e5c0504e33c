"""Personal data and secrets by patterns and a skip-chain conditional random field.

Base spans come from patterns (email, ip, card, phone); values that stand after a word
like ``token =`` are seeds of a fifth kind, secret. The field's nodes are all tokens of all
documents that hold a digit or an at sign; neighbours share chain potentials, and
tokens of a document that are equal, have the same digits, or name the same mailbox
share skip potentials, from each occurrence to the next. Tokens within base spans and
seeds are clamped. Loopy message passing over each document labels the remaining tokens:
by their own shape, and alike with their counterparts, as a number written without its
prefix, a mailbox without its host, a secret without its name. Tokens surely of a kind
are joined into added spans; base spans always stay.

Node, chain and skip weights are fitted together, by the pseudo-likelihood of the
tokens' labels given their neighbours' and counterparts'. A labelled token counts once as
it is and once without the marks that gave it away (prefix, check digit, name): with
its label where a counterpart has one, else as none, so that the counterpart decides. A
token without a label whose counterpart has one is no evidence and isn't counted.

Cases: a null or empty text has no spans; repeated rows each get theirs; an empty table
gives an empty result; long texts are scanned in linear time. Spans of one start
are ordered by kind; a token that could be of several kinds gets the likeliest. Columns
``base``, ``spans`` and ``redacted`` of the input are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
#: Tokens are joined to a span over gaps of so many characters; a label counts from this probability on.
MAX_GAP, SURE, ROUNDS = 2, 0.9, 60
#: Log potential of one label in two counterparts to which the fitted weights are drawn: without examples, counterparts agree.
AGREE = 8.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The look-behind changes no match, as a match takes its whole last number; it keeps long numbers linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Words before a secret.
_NAMED = re.compile(r"(?:token|secret|password|passwd|pwd|auth|bearer|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?\Z", re.I)
_VALUE = re.compile(r"[A-Za-z0-9+/_=-]{16,}\Z")
_MARK = re.compile(r"[0-9@]")
_WORD_END = re.compile(r"\s")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+(@)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), sorted."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at + 1)
        start = at
        if host:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, host.end()))
                free = host.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an at sign, without punctuation around them."""
    found, pos = [], 0
    while m := _MARK.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        stop = _WORD_END.search(text, m.end())
        end = pos = stop.start() if stop else len(text)
        core = text[start:end].lstrip(_STRIP)
        a = end - len(core)
        b = a + len(core.rstrip(_STRIP))
        if a < b:
            found.append((a, b))
    return found


def keys(token: str) -> list[str]:
    """What a token shares with its counterparts; short numbers are no evidence."""
    low = token.lower()
    digits = "".join(c for c in low if "0" <= c <= "9")
    found = [f"t{low}"] if len(low) >= 5 or len(digits) >= 3 else []
    if len(digits) >= 7:
        found.append(f"d{digits[-10:]}")
    local = low.partition("@")[0]
    if len(local) >= 5:
        found.append(f"m{local}")
    return found


def secret_like(token: str) -> bool:
    """Long, of letters and digits, and of many different ones."""
    return bool(_VALUE.match(token)) and len(set(token)) >= 8 and any(c.isalpha() for c in token) and any(c.isdigit() for c in token)


def shape(token: str, before: str, named: bool) -> int:
    """Features of a token, one bit each."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    n, rest = len(digits), len(token)
    bits = (
        "@" in token,
        token.count(".") == 3 and n + 3 == rest,
        n == rest,
        n <= 3,
        4 <= n <= 7,
        8 <= n <= 13,
        14 <= n <= 19,
        14 <= n <= 19 and luhn(digits),
        token[:1] == "+",
        token[:1] == "(",
        "-" in token,
        any(c.isalpha() for c in token),
        before[:1] == "+",
        before[:1] == "(",
        secret_like(token),
        named,
    )
    return sum(1 << k for k, b in enumerate(bits) if b)


#: Bits that a labelled token also counts without: check digit, prefixes, the name of a secret.
GIVEN_AWAY = sum(1 << k for k in (7, 8, 9, 12, 13, 15))
N_BITS = 16


@dataclass
class Graph:
    """The fields of a batch of documents as one graph."""

    owner: list[int]
    spans: list[tuple[int, int]]
    masks: list[int]
    clamped: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(texts: list[str], base: list[list[tuple[int, int, int]]]) -> Graph:
    g = Graph([], [], [], [], [], [])
    for k, text in enumerate(texts):
        last: dict[str, int] = {}
        spans, at, before = base[k], 0, ""
        for a, b in tokens(text):
            node, token = len(g.owner), text[a:b]
            while at < len(spans) and spans[at][2] <= a:
                at += 1
            inside = [x[1] + 1 for x in spans[at : at + 3] if x[0] < b and a < x[2]]
            named = bool(_NAMED.search(text, max(0, a - 24), a))
            if not inside and named and secret_like(token):
                inside = [len(KINDS)]
            g.owner.append(k)
            g.spans.append((a, b))
            near = node > 0 and g.owner[node - 1] == k and a - g.spans[node - 1][1] <= MAX_GAP
            g.masks.append(shape(token, before if near else "", named))
            g.clamped.append(inside[0] if inside else 0)
            if near:
                g.chain.append((node - 1, node))
            linked = set()
            for key in keys(token):
                if key in last and last[key] not in linked and last[key] != node:
                    g.skip.append((last[key], node))
                    linked.add(last[key])
                last[key] = node
            before = token
    return g


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens by shape, label, labels before and after (-1: none), and number of counterparts of each label."""
    labels, found = len(KINDS) + 1, Counter()
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t and _MARK.search(t)]
        g = graph_of(texts, [base_spans(t) for t in texts])
        before, after = [-1] * len(g.owner), [-1] * len(g.owner)
        for a, b in g.chain:
            after[a], before[b] = g.clamped[b], g.clamped[a]
        like = [[0] * labels for _ in g.owner]
        for a, b in g.skip:
            like[a][g.clamped[b]] += 1
            like[b][g.clamped[a]] += 1
        for mask, label, x, y, z in zip(g.masks, g.clamped, before, after, like, strict=True):
            if label or not any(z[1:]):
                found[mask, label, x, y, *z] += 1
                bare = mask & ~GIVEN_AWAY
                if label and any(z[1:]):
                    found[bare, label, x, y, *z] += 1
                elif label and bare != mask:
                    found[bare, 0, min(x, 0), min(y, 0), *z] += 1
    rows = [[*k, n] for k, n in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["row"])


@dataclass
class FieldModel:
    """node: (N_BITS + 1, labels) weights by feature and label; chain, skip: log potentials by the labels of both tokens."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit_field(docs: DataFrame, max_patterns: int = 20_000, steps: int = 600) -> FieldModel:
    """Weights from the tokens of all documents.

    Tokens of one shape, label and neighbourhood are one row with a count; the max_patterns most
    frequent ones are fitted.
    """
    rows = docs.select("text").mapInArrow(_count, "row array<long>")
    rows = rows.groupBy(F.slice("row", 1, F.size("row") - 1).alias("pattern")).agg(F.sum(F.element_at("row", -1)).alias("n"))
    rows = rows.orderBy(F.desc("n"), "pattern").limit(max_patterns).collect()
    labels = len(KINDS) + 1
    model = FieldModel(np.zeros((N_BITS + 1, labels)), np.zeros((labels, labels)), np.zeros((labels, labels)))
    model.node[-1, 0] = 5.0
    if not any(r["pattern"][1] for r in rows):
        return model
    made = np.array([r["pattern"] for r in rows], dtype=np.int64)
    weight = np.array([r["n"] for r in rows], dtype=float)
    weight *= min(1.0, 20_000 / weight.sum())
    x = np.hstack([(made[:, :1] >> np.arange(N_BITS)) & 1, np.ones((len(made), 1), dtype=np.int64)]).astype(float)
    one = lambda y: (y[:, None] == np.arange(labels)).astype(float)
    y, before, after, like = one(made[:, 1]), one(made[:, 2]), one(made[:, 3]), made[:, 4:].astype(float)
    agree = AGREE * np.eye(labels)
    # Steepest ascent with momentum and a step for each weight (Adam), on the penalised pseudo-likelihood.
    weights = [np.zeros_like(model.node), np.zeros_like(model.chain), agree]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        node, chain, skip = weights
        z = x @ node + before @ chain + after @ chain.T + like @ skip
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        error = weight[:, None] * (y - p / p.sum(axis=1, keepdims=True))
        both = like.T @ error
        for k, gradient in enumerate((x.T @ error - node, before.T @ error + (after.T @ error).T - chain, (both + both.T) / 2 - (skip - agree))):
            mean[k] = 0.9 * mean[k] + 0.1 * gradient
            square[k] = 0.999 * square[k] + 0.001 * gradient**2
            weights[k] = weights[k] + 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return FieldModel(*weights)


def propagate(g: Graph, model: FieldModel) -> np.ndarray:
    """Label probabilities of each node by damped sum-product message passing, until messages stand still."""
    labels = model.chain.shape[0]
    bits = (np.array(g.masks)[:, None] >> np.arange(N_BITS)) & 1
    local = bits @ model.node[:-1] + model.node[-1]
    local -= np.logaddexp.reduce(local, axis=1, keepdims=True)
    clamped = np.array(g.clamped)
    local[clamped > 0] = -30.0
    local[np.flatnonzero(clamped > 0), clamped[clamped > 0]] = 0.0
    pairs = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
    if not len(pairs):
        return np.exp(local)
    potential = np.concatenate([np.broadcast_to(model.chain, (len(g.chain), labels, labels)), np.broadcast_to(model.skip, (len(g.skip), labels, labels))])
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), labels))
    for _ in range(ROUNDS):
        belief = local.copy()
        np.add.at(belief, target, message)
        new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + potential, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.3 * message + 0.7 * new
        if moved < 1e-4:
            break
    belief = local.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def _holds(kind: int, text: str, known: set[str]) -> bool:
    """Whether joined tokens can be of the kind: enough of a number or address to tell."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return "@" in text or text.lower() in known
    if kind == 4:
        return secret_like(text)
    if kind == 1:
        return text.count(".") >= 3 and digits >= 4
    return digits >= (12 if kind == 2 else 7)


def find_spans(texts: list[str], model: FieldModel) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, as (start, place in KINDS, end)."""
    which = [k for k, t in enumerate(texts) if _MARK.search(t)]
    base: list[list] = [[] for _ in texts]
    for k in which:
        base[k] = base_spans(texts[k])
    every = [list(b) for b in base]
    g = graph_of([texts[k] for k in which], [base[k] for k in which])
    if g.owner:
        p = propagate(g, model)
        label = np.where(p[:, 1:].max(axis=1) >= SURE, p[:, 1:].argmax(axis=1), -1)
        clamped = np.array(g.clamped)
        label[(clamped > 0) & (clamped <= len(BASE_KINDS))] = -1
        open_span: list[int] | None = None
        found = []
        for node in np.flatnonzero(label >= 0).tolist():
            k, (a, b), kind = g.owner[node], g.spans[node], int(label[node])
            if open_span and open_span[0] == k and open_span[1] == kind and kind != 4 and a - open_span[3] <= MAX_GAP:
                open_span[3] = b
            else:
                open_span = [k, kind, a, b]
                found.append(open_span)
        for k, kind, a, b in found:
            text, own = texts[which[k]], base[which[k]]
            known = {text[x[0] : x[2]].lower().partition("@")[0] for x in own if x[1] == 0}
            if _holds(kind, text[a:b], known) and not any(x[0] < b and a < x[2] for x in own):
                every[which[k]].append((a, kind, b))
    return [(b, sorted(e)) for b, e in zip(base, every, strict=True)]


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, model: FieldModel | None = None) -> DataFrame:
    """docs with base, spans (arrays of kind, start, end in code points) and redacted in place of columns of these names."""
    model = model or fit_field(docs)
    taken = [f for f in docs.schema.fields if f.name not in ("base", "spans", "redacted")]
    names = [f.name for f in taken]

    def rows(spans: list) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = find_spans(texts, model)
                clean = [redact(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
                clean = [None if old is None else new for old, new in zip(batch.column("text").to_pylist(), clean, strict=True)]
                columns = [pa.array([rows(b) for b, _ in found], kind), pa.array([rows(s) for _, s in found], kind), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, "base", "spans", "redacted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in taken] + [f"base {SPAN_TYPE}", f"spans {SPAN_TYPE}", "redacted string"])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def redact_pii(docs: DataFrame, model: FieldModel | None = None) -> DataFrame:
    """docs (text and others) with personal data replaced by its kind; n_chars, if there, follows a text that changes."""
    model = model or fit_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts, changed = batch.column("text").to_pylist(), {}
                for k, (_, spans) in enumerate(find_spans([t or "" for t in texts], model)):
                    if spans:
                        texts[k] = redact(texts[k], spans)
                        changed[k] = len(texts[k])
                columns = {"text": pa.array(texts, pa.string())}
                if "n_chars" in batch.schema.names:
                    columns["n_chars"] = pa.array([changed.get(k, n) for k, n in enumerate(batch.column("n_chars").to_pylist())], batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
