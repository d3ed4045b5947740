from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts: ids count up, everything else follows."""

    def build(texts, schema=DOCS):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = "word" + "".join(f" w{i % 997}x{i % 89}" for i in range(60_000))
    rows = [(0, None), (1, ""), (2, " \n "), (3, long), (None, "a text without an id that is long enough to count as a paragraph of some words here"), (None, None), (7, "the same row twice"), (7, "the same row twice"), (8, "x")]
    full = [(i, t, None, None, None, 0.5, b"d", 1, "own", True, "r", "l", [1]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, digest binary, rid int, owner string, maybe boolean, _digest string, _label string, gone array<int>")
