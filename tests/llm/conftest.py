import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, size string, digest int, _score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table, with columns whose names operators use inside, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", "y", 1, 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def rough():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, "Hello World of words", "a"), (2, "hello world OF words", "a"), (2, "hello world OF words", "a"), (3, None, "b"), (4, "", None), (5, " \n\t ", "b"), (None, "hello world of words", "a"), (None, None, None),
        (6, "ÄÖ ünïcode Éa", "ä"), (7, "äö ünïcode éa", "B"), (8, long, "a"), (9, long + " x", "a"), (10, "x" * 50_000, "b"), (11, "one", "a"), (12, "one two", "a"), (13, "ONE", "c"),
    ]
