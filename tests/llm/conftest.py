import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(*r, *("en", "s0")[len(r) - 2 :], len(r[1] or ""))[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def odd(documents):
    """Nulls, empty and blank texts, ties and a very long text."""
    return documents(
        [
            (None, None, None, None, None),
            (None, "a row without id says this much", "en", None, 1),
            (1, None, None, "s1", None),
            (2, "", "en", "s1", 0),
            (3, " \t\n ", "de", None, 4),
            (4, "one two three four five six", "en", "s1", 27),
            (4, "one two three four five six", "en", "s1", 27),
            (5, "One TWO three four five six", "en", "s2", 27),
            (6, "wörter ünd straße été ñandú 漢字 🙂 a b", "de", "s2", 30),
            (7, "long " * 300_000, "en", "s3", 1_500_000),
            (-8, "!!! 123 ???", "en", "s3", 11),
        ]
    )
