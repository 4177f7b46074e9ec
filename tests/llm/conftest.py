import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must survive: null and empty texts, null and repeated ids, repeated rows, a
    very long text, one word, blanks of all kinds, characters outside the basic plane."""
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, " \t\n\r\x0b\x0c ", None, "s"), (None, "null id text", "en", "s"),
            (None, None, None, None), (4, "word", "en", "s"), (5, "same text here\nsame text here", "en", "s"),
            (5, "same text here\nsame text here", "en", "s"), (5, "other text under the same id", "en", "s"),
            (6, "🙂 été 漢字     x́ ﬁ \x1c 'll don't", "fr", "s"),
            (7, "lorem ipsum dolor sit amet " * 20_000, "en", "s"), (8, "a" * 100_000, "en", "s"),
            (9, "\n".join(f"line number {i % 7}" for i in range(5_000)), "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def clash(odd):
    """The same rows with columns named like the operators' own ones."""
    from pyspark.sql import functions as F
    names = ["score", "fp", "key", "spans", "leaks", "ledger", "lines", "tkey", "pos", "h1", "n_words", "ids", "k",
             "number", "made", "c0", "start", "votes", "base", "Leaks_"]
    return odd.select(*[F.lit(i).alias(n) for i, n in enumerate(names)], "*")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
