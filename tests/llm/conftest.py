import pytest

#: Nulls, empty, tiny, long and repeated texts, texts without words or letters, ties in id, a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The cat."), (5, "Another text of the same id."), (6, "same text " * 30), (7, "same text " * 30), (7, "same text " * 30),
    (None, "a document without an id, of the kind that the tables should not have"), (8, "12345 !!! ---"), (9, "é" * 300), (10, "x" * 5000), (11, "word " * 4000), (12, "<|endoftext|> İΣ ﬁ 日本語 \x00\x1c 👍🏽"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns whose names clash with those the operators use."""
    rows = [(i, t, "en" if n % 3 else None, "s", None if t is None else len(t), n, 0.5, "x", 7) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k long, score double, _k string, rk int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
