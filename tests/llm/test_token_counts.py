"""Token counts against the libraries, and what the cache holds after each run."""

import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from conftest import document

from marlstone.llm import token_counts
from marlstone.llm.token_counts import count_tokens, tokenizer_version

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["<|endoftext|>", "<|EndOfText|>", "<|startoftext|> a <|"]


def plain_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def made_texts():
    rng = random.Random(5)
    letters = ["a", "B", "'S", "'", " ", "\n", "\t", "  \r\n ", "J", "j", "̌", "É", "é", "Σ", "ς", "K", "İ", "9", "!", " ", " ", "漢", "\x1c", "\x0b", "😀", "ffi"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1_500)]
    return [*texts, *SPECIAL, *[t.swapcase() for t in texts[:200]], *[t.replace(" ", " \n") for t in texts[:200]], "J̌ and", "ǰ and"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(spark, file):
    texts = made_texts()
    df = spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double, base string, slot long, print string, kept boolean")
    got = {r.doc_id: r for r in count_tokens(df, public_tokenizers.path(file)).collect()}
    want = plain_counts(public_tokenizers.path(file), texts)
    assert [got[k].n_tokens for k in range(len(texts))] == want
    assert [got[k].n_bytes for k in range(len(texts))] == [len(t.encode()) for t in texts]


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain_counts(WORDS, [r.text or "" for r in rows]), strict=True))
    got = count_tokens(docs, WORDS).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_cache_grows_by_distinct_misses(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(token_counts, "MOST_BROADCAST", bound)
    cache = str(tmp_path / "cache")
    entries = lambda path=WORDS: spark.read.parquet(f"{cache}/version={tokenizer_version(path)}").count()
    docs = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = count_tokens(docs(["one two", "One  TWO", "one\ntwo ", "three", None, ""]), WORDS, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in first) == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 0), (5, 0)] and entries() == 3
    # Stored counts are used: one that is changed in the cache comes back.
    spark.createDataFrame([(0,)], "x int").select(F.unhex(F.sha2(F.lit("known"), 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(f"{cache}/version={tokenizer_version(WORDS)}")
    again = count_tokens(docs(["three", "known", "four five six"]), WORDS, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in again) == [(0, 1), (1, 77), (2, 3)] and entries() == 5
    count_tokens(docs(["three"] * 50), WORDS, cache).collect()
    assert entries() == 5
    other = public_tokenizers.path("byte_bpe_50k.json")
    count_tokens(docs(["three"]), other, cache).collect()
    assert entries(other) == 1 and entries() == 5


def test_odd_documents(odd_docs, no_docs):
    rows = count_tokens(odd_docs, WORDS, limit=2048).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == 12 and {r.doc_id for r in rows} == set(texts)
    assert all([r.n_tokens] == plain_counts(WORDS, [texts[r.doc_id] or ""]) for r in rows)
    assert next(r for r in rows if r.doc_id == 5).over_limit and not next(r for r in rows if r.doc_id == 1).over_limit
    assert count_tokens(no_docs, WORDS).count() == 0
    with pytest.raises(ValueError, match="no library"):
        count_tokens(no_docs, "ids.txt")


def test_composed_letters_are_not_lowered_together():
    assert unicodedata.normalize("NFC", "ǰ") != unicodedata.normalize("NFC", "J̌").lower()
