"""The queries of the corpus operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.collocations import collocations
from marlstone.llm.cotrain import fit_quality, score_quality
from marlstone.llm.decontaminate import find_contamination
from marlstone.llm.html_extract import extract_text
from marlstone.llm.licenses import scan_licenses
from marlstone.llm.oracles import COLLOCATIONS, CONVERSATION_TRIE, NEAR_DUPLICATES, QUALITY_RULES
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import BASE_KINDS, find_pii
from marlstone.llm.prefix_trie import conversation_trie
from marlstone.llm.quality_rules import quality_rules
from marlstone.llm.setsketch import near_duplicates
from marlstone.llm.token_counts import count_tokens
from marlstone.llm.toxicity import fit_toxicity, score_toxicity
from marlstone.llm.training_order import write_training_order
from marlstone.sources.tables import table


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [count("base", k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), count("spans", "secret").alias("n_secret"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_training_order(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_changed")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), word_tokenizer())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_training_order": op2_training_order,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_cotraining_quality": op7_cotraining_quality,
    "op8_license_scan": op8_license_scan,
    "op9_setsketch_dedup": op9_setsketch_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {"op6_quality_rules": QUALITY_RULES, "op9_setsketch_dedup": NEAR_DUPLICATES, "op11_prefix_trie": CONVERSATION_TRIE, "op13_collocations": COLLOCATIONS}
