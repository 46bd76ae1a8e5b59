import random

import pytest

#: Extra columns whose names clash with those that operators use inside.
EXTRA = "score double, fp long, row long, batch int, h1 long, label string, key string, words string, tokens long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def doc_rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), 0.5, 1, 2, 3, 4, "x", "k", "w", 5) for i, t in enumerate(texts)]


@pytest.fixture
def odd_texts():
    random.seed(11)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    long = " ".join(random.choice(words) for _ in range(20_000))
    return [None, "", " ", "one", "One", "é ñ ü", "same text here\nand a line of more than forty characters, many times over", "same text here\nand a line of more than forty characters, many times over", long, long + " end", "a  b\n\n\tc ", "\n\n"]


@pytest.fixture
def odd_docs(spark, odd_texts):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing extra columns."""
    rows = doc_rows(odd_texts)
    rows += [rows[3], (None, "no id", None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (3, "another text of id three", "en", None, None, *[None] * 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
