"""A training corpus from raw documents, in five stages.

Each stage reads the table that its predecessor kept, and its decisions take effect:
rejected documents, near-duplicates and contaminated documents go, personal data is
replaced, and what is left is packed into sequences. Clean documents pass unchanged.

Stages handle null texts as empty ones, empty tables and further columns, which they
keep, as their operators do. A very long text is read whole by every stage. Repeated rows are near-duplicates of each other, so
one document of their group stays, that of the smallest doc_id; a document without doc_id is in no group and
stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import materialise
from marlstone.llm.cotrain import fit_quality, keep_quality
from marlstone.llm.decontaminate import drop_contaminated
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import redact_pii
from marlstone.llm.queries import word_tokenizer
from marlstone.llm.setsketch import drop_near_duplicates
from marlstone.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can't express the classifier or the field; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
