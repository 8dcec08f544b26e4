import pytest

from tests.conftest import spark  # noqa: F401

SF = "/root/testdata/sf0.001"
WORDS = ("able acid aged also area army away baby back ball band bank base bath bear beat been beer bell belt best bill bird "
         "blow blue boat body bomb bond bone book boom born boss both bowl bulk burn bush busy call calm came camp card care "
         "case cash cast cell chat chip city club coal coat code cold come cook cool cope copy core cost crew crop dark data").split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):  # noqa: F811
    """Nulls in every column, empty, odd and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(0, None, None, "a"), (1, "", "en", "a"), (2, "  \n\t ", "en", None), (3, "one", "en", "b"), (4, "one two three", None, "b"),
            (None, "row without an id", "en", "c"), (None, None, None, None), (5, prose(1, 80), "en", "k"), (5, prose(1, 80), "en", "k"),
            (6, prose(1, 80), "fr", "k"), (7, prose(2, 20000), "en", "k"), (8, "x" * 5000, "en", "k"), (9, "éè 日本 😀 €", "fr", "k"),
            (10, "1234 !!", "en", "k"), (11, "a<|endoftext|>b", "en", "k"), (7, prose(3, 60), "en", "k"), (12, "one", "en", "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string").selectExpr(
        "doc_id", "text", "lang", "cast(null as string) as source", "cast(length(text) as bigint) as n_chars", "key", "key as stats",
        "doc_id as uid", "key as pos", "key as word", "key as head", "key as least", "key as drop", "key as n_dropped")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
