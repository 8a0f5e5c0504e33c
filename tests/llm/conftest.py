import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, slot long, print string, kept boolean"


def document(doc_id, text, lang="en", source="s", n=None):
    return (doc_id, text, lang, source, n if n is not None else len(text or ""), 1.0, "b", 1, "p", True)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows, ties, clashing columns."""
    long_text = prose(1, 60_000)
    rows = [
        document(1, None), document(2, ""), document(3, " \n\t "), document(4, "one two"), document(5, long_text), document(6, prose(2, 80)), document(7, prose(2, 80)), document(7, prose(2, 80)),
        document(None, prose(3, 60)), (8, prose(4, 60), None, None, None, None, None, None, None, None), document(9, "9" * 5000 + "@" * 50), document(10, "x" * 100_000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
