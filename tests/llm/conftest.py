import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """Rows of (doc_id, text, source) as the documents table, with further columns of clashing names."""
    names = "".join(f", `{n}` string" for n in extra)
    data = [(i, t, "en", s, len(t) if t else None, *("x" for _ in extra)) for i, t, s in rows]
    return spark.createDataFrame(data, DOCS + names)


CLASHING = (
    "key", "hash", "size", "component", "score", "rank", "part", "n", "id", "spans", "ids", "start", "base", "target", "weight", "kept", "block"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing column names."""
    long_text = "alpha beta gamma delta epsilon zeta eta theta\n" * 40_000
    rows = [
        (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, long_text, "b"), (None, "only words without an id here", "b"),
        (5, "Öne twö thréé", None), (5, "Öne twö thréé", None), (6, long_text, "b"), (7, "x" * 300_000, "c"), (None, None, None),
    ]
    return documents(spark, rows, CLASHING)
