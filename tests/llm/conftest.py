import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, null ids, null and empty and long texts, and columns named like the operators' own."""
    rows = [
        (1, "the same text stands here twice or more", "a", 1), (1, "the same text stands here twice or more", "a", 1), (2, "the same text stands here twice or more", None, None),
        (None, "a row without an id", "b", 2), (None, None, None, None), (3, None, "c", 3), (4, "", "d", 4), (5, " \n\t ", "e", 5), (6, LONG, "f", 6), (7, "one", "g", 7),
    ]
    rows = [(i, t, k, n, 1, "x", 2, 3, "y") for i, t, k, n in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long, id int, fp string, row int, tile int, spans string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
