import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30000))
#: Null and repeated rows, empty and blank texts, one very long text, ties, and columns whose names clash with those used inside.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog.", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, "  \n\t ", None),
    (None, "no id here", "b"),
    (5, LONG, "a"),
    (6, "x" * 50000, "b"),
    (7, "the quick brown fox jumps over the lazy dog.", "c"),
    (7, "the quick brown fox jumps over the lazy dog.", "c"),
    (8, "Ünïcödé ßtraße 漢字 😀 Σίσυφος <|endoftext|> it's", "c"),
]
EXTRA = ["size", "p", "block", "key", "n", "base", "found", "spans", "salt", "rep", "kind", "row_key", "z", "target"]
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t) if t is not None else None, *["x"] * len(EXTRA)) for i, t, s in rows], SCHEMA)


@pytest.fixture
def edge(spark):
    return table(spark, EDGE)


@pytest.fixture
def empty(spark):
    return table(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
