"""Quality scores by co-training of a content view and a metadata view.

One classifier sees only the text (rates, and hashed words whose weights are learned), the
other only the page's metadata (source, language, stated length). Both start from the labelled
rows; in each round both score all unlabelled documents, in Spark, from a written table of their views, and each
takes those that the other is surest of, in the classes' proportions, with the other's label. Tasks send
their surest rows only, a fixed number for each view and class. No labelled row, and so none that is kept
aside, takes part. At the end each view is calibrated on labelled
rows kept aside, and a logistic fit of the two calibrated views, with no negative weight, scores every document:
a view that says nothing has the weight 0. Documents below a cutoff are rejected; it is 0.5, or lower where more than
``max_false`` of the good rows kept aside would go.

Cases: a null or empty text has the content features of an empty text; null metadata
is a value of its own; repeated rows score alike; a very long text is read whole; rows of one hash
are taken in the order of doc_id; further columns aren't read, and kept by ``keep_quality``; without labels of both classes all
documents are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import logistic_fit, materialise, sigmoid

BUCKETS = 32
WORD_BUCKETS = 64
N_CONTENT = 13 + WORD_BUCKETS


def content_view(text: str) -> list[float]:
    """Rates of the text (symbols, case, repetition, words and lines), and the share of distinct words in each hashed bucket."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = chars - text.count(" ")
    distinct = len(counts) / n
    buckets = Counter(map(WORD_BUCKETS.__rmod__, map(zlib.crc32, map(str.encode, counts))))
    share = [buckets[k] * WORD_BUCKETS / max(len(counts), 1) / 4 for k in range(WORD_BUCKETS)]
    return share + [
        min(10.0, 10 * sum(map(text.count, "#*$%&<>")) / n),
        min(10.0, 10 * text.count("|") / n),
        min(10.0, 10 * (text.count("!") + text.count("?")) / n),
        10 * sum(map(str.isupper, words)) / n,
        10 * sum(map(str.isdigit, words)) / n,
        distinct,
        # Long texts repeat their common words; the square root of the length is the usual pace.
        min(5.0, distinct * n**0.5 / 5),
        10 * max(counts.values(), default=0) / n,
        10 * sum(map(operator.eq, words, words[1:])) / n,
        10 * (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(5.0, letters / n / 4),
        min(5.0, 20 * len(lines) / n),
        np.log1p(len(words)) / 3,
    ]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int | float]:
    """Buckets of source and language, and the logarithm of the length."""
    bucket = lambda kind, x: zlib.crc32(f"{kind}:{x}".encode()) % BUCKETS
    return [bucket("s", source), BUCKETS + bucket("l", lang), np.log1p(max(n_chars or 0, 0)) / 3]


def _wide(meta: np.ndarray) -> np.ndarray:
    x = np.zeros((len(meta), 2 * BUCKETS + 1))
    rows = np.arange(len(meta))
    x[rows, meta[:, 0].astype(int)] = 1
    x[rows, meta[:, 1].astype(int)] = 1
    x[:, -1] = meta[:, 2]
    return x


@dataclass
class QualityModel:
    """Weights of both views (None: keep all), their calibrations, the combination, and the cutoff."""

    content: np.ndarray | None = None
    metadata: np.ndarray | None = None
    calibration: tuple[np.ndarray, np.ndarray] | None = None
    combination: np.ndarray | None = None
    cutoff: float = 0.0

    def logits(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        a = content @ self.content[:-1] + self.content[-1]
        b = _wide(meta) @ self.metadata[:-1] + self.metadata[-1]
        return tuple(np.clip(c[0] * np.clip(z, -30, 30) + c[1], -12, 12) for c, z in zip(self.calibration, (a, b), strict=True))

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of quality by content, by metadata, and by both."""
        if self.content is None:
            one = np.ones(len(content))
            return one, one, one
        a, b = self.logits(content, meta)
        return sigmoid(a), sigmoid(b), sigmoid(np.stack([a, b], axis=1) @ self.combination[:-1] + self.combination[-1])


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_view(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, N_CONTENT)
    meta = np.array([metadata_view(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)], dtype=float).reshape(-1, 3)
    return content, meta


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts and their views at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _collect_views(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views, label and fold of the documents in chosen (doc_id, label, fold), which is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = _views(batch)
            yield pa.RecordBatch.from_arrays([pa.array(content.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.float64())), batch.column("label"), batch.column("fold")], ["content", "meta", "label", "fold"])

    # One row stands for those that repeat a doc_id, so what reaches the driver is as bounded as chosen.
    found = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row")).select("label", "fold", "row.*")
    rows = found.mapInArrow(run, "content array<double>, meta array<double>, label int, fold int").collect()
    rows.sort(key=lambda r: (r["label"], r["fold"], r["content"], r["meta"]))
    part = lambda c, w: np.array([r[c] for r in rows], dtype=float).reshape(-1, *w)
    return part("content", (N_CONTENT,)), part("meta", (3,)), part("label", ()), part("fold", ())


def _surest(features: DataFrame, fitted: list[np.ndarray], most: tuple[int, int], taken: set, kind: str) -> list:
    """(teacher, label, doc_id, content, meta): for each view the rows that it is surest of, ``most`` of class 0 and 1, of all documents but those taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {(t, c): [] for t in (0, 1) for c in (0, 1)}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw = batch.column("content"), batch.column("meta")
            content, meta = (np.asarray(r.flatten()).reshape(len(ids), -1) for r in raw)
            free = np.array([i not in taken for i in ids])
            for teacher, x in enumerate((content, _wide(meta))):
                p = sigmoid(x @ fitted[teacher][:-1] + fitted[teacher][-1])
                for label, unsure in ((0, p), (1, 1 - p)):
                    # Many rows of one source are equally sure, so ties go by doc_id; a repeated one counts once.
                    new = {}
                    for u, i, k in sorted((float(unsure[k]), ids[k], int(k)) for k in np.flatnonzero(free & (unsure < 0.1))):
                        if len(new) == most[label]:
                            break
                        new.setdefault(i, (u, i, content[k].tolist(), meta[k].tolist()))
                    first = {}
                    for r in sorted([*best[teacher, label], *new.values()], key=lambda r: r[:2]):
                        first.setdefault(r[1], r)
                    best[teacher, label] = list(first.values())[: most[label]]
        rows = [(t, c, *r) for (t, c), found in best.items() for r in found]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int32(), pa.int32(), pa.float64(), id_type, pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["teacher", "label", "unsure", "doc_id", "content", "meta"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(features.schema["doc_id"].dataType)
    found = features.mapInArrow(run, f"teacher int, label int, unsure double, doc_id {kind}, content array<double>, meta array<double>")
    found = found.groupBy("teacher", "label", "doc_id").agg(F.min(F.struct("unsure", "content", "meta")).alias("r"))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("teacher", "label").orderBy("r.unsure", "doc_id")))
    rows = placed.where(F.col("place") <= F.when(F.col("label") == 0, most[0]).otherwise(most[1])).select("teacher", "label", "place", "doc_id", "r.content", "r.meta").collect()
    return sorted(rows, key=lambda r: (r["teacher"], r["label"], r["place"]))


def _not_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic fit whose weights, but the intercept, aren't below 0: columns that would be are left out, the worst first."""
    kept = list(range(x.shape[1]))
    while kept:
        beta = logistic_fit(x[:, kept], y, l2=0.1)
        if beta[:-1].min() >= 0:
            break
        kept.pop(int(np.argmin(beta[:-1])))
    else:
        beta = logistic_fit(x[:, :0], y, l2=0.1)
    out = np.zeros(x.shape[1] + 1)
    out[kept], out[-1] = beta[:-1], beta[-1]
    return out


def unlabelled_views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, content, meta): a written table of the views of all documents without a label; texts aren't moved."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            content, meta = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content.tolist(), pa.list_(pa.float32())), pa.array(meta.tolist(), pa.list_(pa.float32()))], ["doc_id", "content", "meta"])

    views = docs.where("doc_id is not null").select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, f"doc_id {kind}, content array<float>, meta array<float>")
    return materialise(views.join(labels.select("doc_id").distinct(), "doc_id", "left_anti"), "quality-views")


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, rounds: int = 5, per_round: int = 200, max_false: float = 0.002) -> QualityModel:
    """Fit on at most max_labelled labelled rows, taken by a hash of doc_id, and on what the views teach each other about all other documents.

    docs: (doc_id, text, source, lang, n_chars); labels: (doc_id, quality 0 or 1). A fifth
    of the labelled rows is kept aside to calibrate.
    """
    by_hash = F.xxhash64("doc_id", F.lit("quality"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    labelled = known.withColumn("fold", F.pmod(by_hash, F.lit(5)).cast("int")).orderBy(by_hash, "doc_id").limit(max_labelled)
    content, meta, label, fold = _collect_views(docs, materialise(labelled, "quality-chosen"))
    train, held = fold > 0, fold == 0
    if any(len(set(label[m])) < 2 for m in (train, held)):
        return QualityModel()
    views = [content, _wide(meta)]
    own = [(v[train], label[train], np.ones(int(train.sum()))) for v in views]
    good = float(label[train].mean())
    most = (max(1, int(per_round * (1 - good))), max(1, int(per_round * good)))
    features, taken = unlabelled_views(docs, known) if rounds else None, set()
    for _ in range(rounds):
        fitted = [logistic_fit(x, y, l2=1.0, weight=w) for x, y, w in own]
        rows = _surest(features, fitted, most, taken, docs.schema["doc_id"].dataType.simpleString())
        for teacher, pupil in ((0, 1), (1, 0)):
            if mine := [r for r in rows if r["teacher"] == teacher]:
                x, y, w = own[pupil]
                new = np.array([r["content" if pupil == 0 else "meta"] for r in mine], dtype=float)
                own[pupil] = (np.vstack([x, new if pupil == 0 else _wide(new)]), np.append(y, [float(r["label"]) for r in mine]), np.append(w, np.full(len(mine), 0.5)))
        taken |= {r["doc_id"] for r in rows}
        if not rows:
            break
    model = QualityModel(*[logistic_fit(x, y, l2=1.0, weight=w) for x, y, w in own])
    raw = [np.clip(v[held] @ b[:-1] + b[-1], -30, 30) for v, b in zip(views, (model.content, model.metadata), strict=True)]
    model.calibration = tuple(_not_negative(z[:, None], label[held]) for z in raw)
    model.combination = _not_negative(np.stack(model.logits(content[held], meta[held]), axis=1), label[held])
    sure = np.sort(model.scores(content[held], meta[held])[2][label[held] == 1])
    model.cutoff = float(min(0.5, sure[int(max_false * len(sure))]))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, kept) for each row of docs (doc_id, text, source, lang, n_chars)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            a, b, both = model.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= model.cutoff)], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, f"doc_id {kind}, content_score double, metadata_score double, score double, kept boolean")


def keep_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            yield batch.filter(pa.array(model.scores(*_views(batch))[2] >= model.cutoff))

    return docs.mapInArrow(run, docs.schema)
