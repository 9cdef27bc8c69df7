"""Small tables with the rows that tend to break operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, id string, start long, key long, variant long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts, with extra columns whose names operators use inside."""

    def make(texts: list, first: int = 0):
        rows = [(first + i, t, "en", "s", None if t is None else len(t), 7, "x", 3, 5, 6) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blanks, one word, repeated rows, other scripts, a very long text."""
    words = [f"w{i % 977}x{i % 31}" for i in range(40_000)]
    return [None, "", "   ", "one", "two words", "the same text twice over", "the same text twice over", "ß ñ 語 語 ü é \U0001f600", "a\n\nb\t c", " ".join(words)]
