import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like results."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 5),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", None, 5),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", None, 5),
        (3, None, "en", "s", None), (4, "", None, "s", 0), (5, " \n\t ", "en", "s", 0), (None, "nobody's text", "en", "s", 1), (None, None, None, None, None),
        (6, LONG, "en", "s", 1), (7, "one", "en", "s", 1), (8, "12345 67890 !!!", "en", "s", 1), (9, "İstanbul ǅ 漢字 \U0001F600 Straße", "de", "s", 1), (7, "another text for seven", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"n_words": "1", "kept": "true", "keep_id": "-1", "digest": "'x'", "row": "'r'", "score": "2.0", "ids": "'i'", "rkey": "0", "content": "'c'", "base": "'b'"}
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
