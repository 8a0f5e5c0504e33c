"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm.cotrain import fit_quality, keep_quality, score_quality
from marlstone.llm.decontaminate import drop_contaminated, find_contamination
from marlstone.llm.html_extract import extract_text
from marlstone.llm.licenses import scan_licenses
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import find_pii, redact_pii
from marlstone.llm.quality_rules import quality_rules
from marlstone.llm.setsketch import drop_near_duplicates, near_duplicates
from marlstone.llm.toxicity import fit_toxicity, score_toxicity
from marlstone.llm.training_order import write_training_order

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "some words that are an item of nobody"), (3, "one two"), (3, "one two")], "item_id long, text string")


def test_pii(odd_docs, no_docs):
    found = {(r.doc_id, r.text): r for r in find_pii(odd_docs).collect()}
    assert len(find_pii(odd_docs).collect()) == 12
    assert found[1, None].spans == [] and found[1, None].redacted is None and found[2, ""].redacted == ""
    assert find_pii(no_docs).count() == 0
    assert redact_pii(odd_docs).columns == odd_docs.columns and redact_pii(odd_docs).count() == 12


def test_training_order(odd_docs, no_docs):
    rows = write_training_order(odd_docs.coalesce(1), TOKENIZER, per_shard=5, row_ids=512).collect()
    assert {r.slot for r in rows} == set(range(max(r.slot for r in rows) + 1)) and {r.doc_id for r in rows} == {None, *range(1, 11)}
    assert next(r for r in rows if r.doc_id == 1).length == 1 and sum(r.length for r in rows if r.doc_id == 7) == 2 * sum(r.length for r in rows if r.doc_id == 6)
    assert write_training_order(no_docs, TOKENIZER).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>Some text that is here."), (4, "u", "<nav>x</nav>"), (4, "u", "<nav>x</nav>"), (5, "u", "<div>" * 20_000)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in extract_text(pages).collect()}
    assert rows[1].text == "" and rows[2].text == "" and rows[4].text == "" and rows[5].text == "" and rows[None].text == "Some text that is here."
    assert extract_text(pages.limit(0)).count() == 0


def test_packing(odd_docs, no_docs):
    rows = pack_documents(odd_docs, TOKENIZER).collect()
    assert [r.length for r in rows if r.doc_id == 1] == [1] and sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == 7 for r in rows) == 2 * sum(r.doc_id == 6 for r in rows)
    assert pack_documents(no_docs, TOKENIZER).count() == 0


def test_decontamination(odd_docs, no_docs, items):
    rows = find_contamination(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(4, 3, 0), (4, 3, 0)]
    kept = drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 11
    assert find_contamination(no_docs, items).count() == 0 and find_contamination(odd_docs, items.limit(0)).count() == 0
    assert drop_contaminated(odd_docs, items.limit(0)).count() == 12


def test_quality_rules(odd_docs, no_docs, odd_labels):
    rows = {r.doc_id: r for r in quality_rules(odd_docs, odd_labels).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[6].kept and rows[8].kept
    assert quality_rules(odd_docs, odd_labels).count() == 12
    assert quality_rules(no_docs, odd_labels).count() == 0 and quality_rules(odd_docs, odd_labels.limit(0)).count() == 12


def test_quality_classifier(odd_docs, no_docs, odd_labels):
    model = fit_quality(odd_docs, odd_labels)
    assert {r.kept for r in score_quality(odd_docs, model).collect()} == {True}
    assert keep_quality(odd_docs, model).columns == odd_docs.columns
    assert keep_quality(no_docs, fit_quality(no_docs, odd_labels)).count() == 0


def test_licenses(odd_docs, no_docs):
    assert scan_licenses(odd_docs).count() == 0 and scan_licenses(no_docs).count() == 0
    noted = odd_docs.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))
    assert {r.license_id for r in scan_licenses(noted).collect()} == {"mit"}


def test_near_duplicates(odd_docs, no_docs):
    rows = {r.doc_id: r for r in near_duplicates(odd_docs).collect()}
    assert rows[1].n_shingles == 0 and rows[1].component_id == 1 and rows[3].n_shingles == 0 and rows[4].n_shingles == 1
    assert rows[6].component_id == rows[7].component_id == 6 and rows[6].kept and not rows[7].kept
    assert rows[None].component_id is None and rows[None].kept
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert near_duplicates(no_docs).count() == 0


def test_toxicity(odd_docs, no_docs, odd_labels):
    rows = score_toxicity(odd_docs, fit_toxicity(odd_docs, odd_labels)).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(no_docs, fit_toxicity(no_docs, odd_labels)).count() == 0


def test_html_of_clashing_columns_and_a_long_page(spark):
    paragraph = "<p>This is a paragraph that goes on for some words, and it ends with a stop.</p>"
    long_page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Long</h1>{paragraph * 4_000}</article><footer>Copyright</footer></body></html>"
    rows = [(1, "u", long_page, "other text", 5, 6, 7, "k"), (2, "v", paragraph, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_blocks int, n_changed int, n_chars long, key string")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert got[1].text.startswith("Long\n\nThis is a paragraph") and got[1].n_content_blocks == 4_001 and "Home" not in got[1].text and "Copyright" not in got[1].text
    assert got[2].text == "This is a paragraph that goes on for some words, and it ends with a stop."


def test_benchmark_of_clashing_columns(odd_docs, spark):
    rows = [(3, "one two", 77, 9, 1, "x"), (None, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id long, distance int, start int, lang string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in find_contamination(odd_docs, items).collect()) == [(4, 3, 0)]
    assert drop_contaminated(odd_docs, items).count() == 11
