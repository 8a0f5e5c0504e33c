"""Token counts with a cache: each distinct content is encoded once for each version of a tokenizer.

The cache is a Parquet table of (digest, n_tokens) in a folder for each version, the
digest of the tokenizer's file, the library's version and the way of normalising. A run
digests every text, anti-joins the distinct digests with the stored ones, encodes one
text for each digest that is missing, appends these counts, and joins every row with
the counts stored. Appending is one committed write: a run that fails adds nothing or
all, and the next one goes on from what is there. Rows that two runs append at once are
equal, and are read as one.

Texts are normalised before they are digested only as far as no count can change: where
the tokenizer drops white space and lowers letters, runs of white space become one
space, and texts that are all ASCII are lowered (beyond it, lowering may keep a letter
and its accent from being composed). Texts with ``<|``, which may begin a special token,
and all texts of other tokenizers are digested as they are.

Cases: a null text counts as empty, with the count of an empty text; repeated rows
are counted each, by one entry; a null doc_id is carried along; very long texts are encoded
whole; further columns aren't read; an empty table gives no rows. Two texts of equal
SHA-256 are taken as equal.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, scratch_dir
from marlstone.llm.tokens import encoder

#: Digests that are sent to all tasks, at most (32 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Bytes of text that are encoded at once, a single text aside.
AT_ONCE = 4 << 20
#: Changes with the rule of normalising, so that older entries aren't met.
RULE = "2"

_COUNTERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """Texts to numbers of tokens, by the library for the file; one for each Python worker and file."""
    if path not in _COUNTERS:
        if path.endswith(".json"):
            e = encoder(path)
            _COUNTERS[path] = lambda texts: e.flat(texts)[1]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: np.array([len(ids) for ids in model.encode(texts, num_threads=1)], dtype=np.int64)
        else:
            raise ValueError(f"no library for {path}: .json and .model files are read")
    return _COUNTERS[path]


def tokenizer_version(path: str) -> str:
    """A digest of the file, its library's version and the rule of normalising."""
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError(f"no library for {path}: .json and .model files are read")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}|{RULE}".encode()).hexdigest()[:32]


def normalised(text: F.Column, path: str) -> F.Column:
    """The text that is digested and encoded: of the same tokens as ``text``."""
    if not (path.endswith(".json") and encoder(path).by_word):
        return text
    spaced = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.contains(text, F.lit("<|")), text).when(F.octet_length(text) == F.length(text), F.lower(spaced)).otherwise(spaced)


def _encoded(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(path)
        for batch in batches:
            texts, found, held, size = batch.column("text").to_pylist(), [], [], 0
            for t in texts:
                if held and size + len(t) > AT_ONCE:
                    found.append(counted(held))
                    held, size = [], 0
                held.append(t)
                size += len(t)
            if held:
                found.append(counted(held))
            n = np.concatenate(found).astype(np.int64) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n)], names=["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; counts come from ``cache``, which gets those it lacks.

    ``cache`` is a folder that all machines share; without it, a new one is begun in the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{cache or f'{scratch_dir(spark)}/token-counts-{uuid.uuid4().hex}'}/version={tokenizer_version(tokenizer)}"
    schema = "digest binary, n_tokens long"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    stored = lambda: spark.read.schema(schema).parquet(folder)

    whole = F.coalesce("text", F.lit(""))
    contents = docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), normalised(whole, tokenizer).alias("text"))
    contents = contents.withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = materialise(contents.drop("text"), "token-digests")
    missing = materialise(digests.select("digest").distinct().join(stored(), "digest", "left_anti"), "token-misses")
    if n := missing.count():
        texts = contents.select("digest", "text")
        if n <= MOST_BROADCAST:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:  # copies go first, so that no text is one task's
            texts = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        texts.mapInArrow(_encoded(tokenizer), schema).write.mode("append").parquet(folder)
    # A written table of the counts wanted: copies of one text are then rows of a plain join, which Spark splits.
    wanted = digests.select("digest").distinct().join(stored(), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialise(wanted, "token-counts-wanted")
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
