import pytest

LONG = "Sehr lange Zeile ohne Ende " * 4000
CLASHING = "hash print row kinds spans words a b row_key text_key held_out score size start key id normal".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from ``(doc_id, text)`` with columns of clashing names."""

    def build(rows, lang=None):
        schema = "doc_id long, text string, lang string, source string, n_chars long, "
        schema += ", ".join(f"`{name}` string" for name in CLASHING)
        full = [
            (i, t, lang[k] if lang else "en", "s", len(t or ""), *["x"] * len(CLASHING))
            for k, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in each column, empty, blank and very long texts, ties, rows that repeat."""
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (5, "one two three four five six"),
        (6, "one  two three four\nfive six "), (4, "one two three four five six"), (None, "nobody's text"),
        (None, None), (9, LONG), (10, LONG), (11, "é"), (12, "1234 5678"), (13, "💥 <|endoftext|> \x00"),
    ]
    return documents(rows, lang=["en", None] * 7)
