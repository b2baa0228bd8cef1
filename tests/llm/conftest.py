"""Rows for the edge cases that every operator must take: nulls, empty and long texts, ties, repeated rows, more columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """Documents from (doc_id, text, source); ``extra`` adds columns with clashing names."""
        full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("id", "root", "m", "_m", "host", "size", "key", "shard", "n_words", "rid", "a", "b", "set", "_gone", "rank", "kept"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    long_text = " ".join(f"word{i % 700}x{i % 13}" for i in range(30_000))
    return [
        (None, "a b c d e f g h i j k l m n o p", "s1"),
        (None, None, None),
        (1, None, "s1"),
        (2, "", "s2"),
        (3, " \t\n\x0b \r\n", "s2"),
        (4, long_text, "s1"),
        (5, long_text, None),
        (6, "one", "s3"),
        (6, "one", "s3"),
        (7, "One TWO three four", "é"),
        (8, "é" * 500 + "\n" + "q" * 900, "s3"),
        (9, "same line of text here again\nsame line of text here again\n# $ % *", "s3"),
    ]
