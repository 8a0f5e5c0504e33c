"""Token ids by a public tokenizer file, for many texts at once.

``Encoder.flat`` gives exactly the ids of ``tokenizers`` without special tokens.
Where the file drops white space and cuts words by the pattern below, no piece
crosses white space, so ids are kept by word; any other file is used as it is. A batch
is one byte string: words are found and hashed by array operations, each distinct word
is looked up once, and ids are gathered. Two words are taken as equal if two
independent 64-bit hashes agree.

Known words are arrays of hashes and ids, of a bounded number of words: beyond it,
those that have not come up for longest are dropped.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np

# Fixed value: the cut of the public word_bpe files.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that are hashed at once.
CHUNK = 1 << 19

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 13, 32]] = True
_STOP, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_LETTER[97:123] = True
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_ENCODERS: dict[str, Encoder] = {}
_POWERS: list[np.ndarray] = []


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, n at least."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in _BASES:
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, CHUNK + 1), x, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
    if n <= CHUNK + 1:  # else one very long word: not kept
        _POWERS[:] = made
    return made


def _chunks(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of raw of about CHUNK bytes that cut no word."""
    start = 0
    while start < len(raw):
        end = start + CHUNK
        if end < len(raw):
            cut = max(raw.rfind(c, start, end) for c in (b" ", b"\n"))
            if cut <= start:  # one long word
                cut = min((at for at in (raw.find(c, end) for c in (b" ", b"\n")) if at >= 0), default=len(raw))
            end = cut
        yield start, min(end, len(raw))
        start = end


class _Table:
    """Words as sorted hashes with their second hash, ids, and the time of the last use."""

    def __init__(self):
        self.key = self.check = np.empty(0, dtype=np.uint64)
        self.start = self.size = self.used = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype="<u4")

    def find(self, key: np.ndarray, check: np.ndarray, now: int) -> np.ndarray:
        """The place of each word, -1 for none; key is sorted."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = np.where((self.key[at] == key) & (self.check[at] == check), at, -1)
        self.used[at[at >= 0]] = now
        return at

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray, used: np.ndarray) -> None:
        """Words that the table lacks; key is sorted."""
        at = np.searchsorted(self.key, key)
        start = len(self.ids) + np.cumsum(size) - size
        for name, new in (("key", key), ("check", check), ("start", start), ("size", size), ("used", used)):
            setattr(self, name, np.insert(getattr(self, name), at, new))
        self.ids = np.concatenate([self.ids, ids])

    def keep(self, which: np.ndarray) -> None:
        size, start = self.size[which], self.start[which]
        self.ids = gathered(self.ids, start, size)
        self.key, self.check, self.size, self.used = (x[which] for x in (self.key, self.check, self.size, self.used))
        self.start = np.cumsum(size) - size


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ids from each start, one after the other."""
    last = np.cumsum(size)
    return ids[np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - size), size)]


class Encoder:
    def __init__(self, path: str, max_words: int = 800_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.max_words, self.now = max_words, 0
        # New words go to a small table first, which is merged into the large one now and then.
        self.recent, self.known = _Table(), _Table()
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
        cut = steps[0] if steps else {}
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers") or []]
        plain = {x["content"] for x in made.get("added_tokens", [])}
        self.special = tuple(plain)
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Split" and cut.get("pattern") == {"Regex": CUT} and cut.get("behavior") == "Removed"
        if self.by_word:
            import regex

            self.cut = regex.compile(CUT)
            # A byte is one letter in the vocabulary: itself if it is printable, else one from 256 on.
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.letters = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in printable)}
            self.model = self.whole.model

    def _plain(self, text: str) -> bool:
        """Whether words can be looked up: the normaliser only lowers letters, alike with and without context."""
        if text.isascii():
            return "<|" not in text or not any(s in text for s in self.special)
        return "Σ" not in text and unicodedata.is_normalized("NFC", text) and not any(s in text for s in self.special)

    def flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), each with end_id if given, and the number of ids of each."""
        plain = [self.by_word and self._plain(t) for t in texts]
        ids, counts = self._by_word([t.lower().encode() for t, p in zip(texts, plain, strict=True) if p])
        if not all(plain):
            parts, own, at = [], np.zeros(len(texts), dtype=np.int64), iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            other = iter(self.whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
            for k, p in enumerate(plain):
                parts.append(next(at) if p else np.array(next(other).ids, dtype="<u4"))
                own[k] = len(parts[-1])
            ids, counts = np.concatenate(parts).astype("<u4"), own
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False), counts + 1
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        ids, counts = self.flat(texts)
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _by_word(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        found, counts = [], np.zeros(len(texts), dtype=np.int64)
        for start, end in _chunks(raw):
            starts, ids, lengths = self._chunk(raw[start:end])
            found.append(ids)
            np.add.at(counts, np.searchsorted(ends, starts + start, side="right"), lengths)
        return (np.concatenate(found) if found else np.empty(0, dtype="<u4")), counts

    def _chunk(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words, all ids, and the number of ids of each word."""
        b = np.frombuffer(raw, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(_SEPARATOR[b].astype(np.int8), prepend=1, append=1))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, np.empty(0, dtype="<u4"), starts
        # A stop after a letter is a piece of its own, so it needs no word with and without it.
        stop = np.flatnonzero((ends - starts > 1) & _STOP[b[ends - 1]] & _LETTER[b[ends - 2]])
        starts, ends = np.insert(starts, stop + 1, ends[stop] - 1), np.insert(ends, stop, ends[stop] - 1)
        hashes, powers = [], _powers(len(b) + 1)
        for k in (0, 1):
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[k][b] * powers[2 * k][: len(b)], out=sums[1:])
            hashes.append((sums[ends] - sums[starts]) * powers[2 * k + 1][starts])
        key, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1][first][which] != hashes[1]).any():  # different words of one hash
            _, first, which = np.unique(np.stack(hashes, axis=1), axis=0, return_index=True, return_inverse=True)
            words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            size, ids = self._ids_of(words)
            lengths = size[which.ravel()]
            return starts, gathered(ids, (np.cumsum(size) - size)[which.ravel()], lengths), lengths
        check = hashes[1][first]
        self.now += 1
        at, recent = self.known.find(key, check, self.now), self.recent.find(key, check, self.now)
        new = np.flatnonzero((at < 0) & (recent < 0))
        words = [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        new_size, new_ids = self._ids_of(words)
        size, start = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        for table, place, offset in ((self.known, at, 0), (self.recent, recent, len(self.known.ids))):
            hit = place >= 0
            size[hit], start[hit] = table.size[place[hit]], table.start[place[hit]] + offset
        size[new], start[new] = new_size, len(self.known.ids) + len(self.recent.ids) + np.cumsum(new_size) - new_size
        # The chunk's own ids first, by distinct word, then by word.
        own = gathered(np.concatenate([self.known.ids, self.recent.ids, new_ids]), start, size)
        lengths = size[which]
        out = gathered(own, (np.cumsum(size) - size)[which], lengths)
        self.recent.add(key[new], check[new], new_size, new_ids, np.full(len(new), self.now))
        if len(self.recent.key) > 50_000:
            r = self.recent
            self.known.add(r.key, r.check, r.size, gathered(r.ids, r.start, r.size), r.used)
            self.recent = _Table()
            if len(self.known.key) > self.max_words:
                self.known.keep(np.sort(np.argsort(-self.known.used, kind="stable")[: self.max_words // 2]))
        return starts, out, lengths

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        found, size = [], np.zeros(len(words), dtype=np.int64)
        tokenize, letters, cut = self.model.tokenize, self.letters, self.cut.findall
        for k, raw in enumerate(words):
            w = raw.decode()
            if w.isalpha():
                made = tokenize(w if w.isascii() else raw.decode("latin-1").translate(letters))
            else:
                made = []
                for p in cut(w):
                    made += tokenize(p.encode().decode("latin-1").translate(letters))
            found += [t.id for t in made]
            size[k] = len(made)
        return size, np.array(found, dtype="<u4")
