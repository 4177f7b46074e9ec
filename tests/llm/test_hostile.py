"""Single texts that once made a task hang."""

import time

import pytest


def seconds(spark, make, text, schema="doc_id long, text string, source string", row=lambda t: (1, t, "s")):
    df = spark.createDataFrame([row("warm 1 up")], schema)
    make(df).collect()
    df = spark.createDataFrame([row(text)], schema)
    began = time.time()
    got = make(df).collect()
    return got[0], time.time() - began


def test_long_token_beside_a_digit(spark):
    from upkeep.llm.pii import find_personal_data
    got, took = seconds(spark, find_personal_data, "a" * 1_000_000 + " 10.0.0.1 " + "b" * 1_000_000)
    assert len(got.base) == 1 and took < 10


def test_many_hex_tokens(spark):
    from upkeep.llm.secrets import find_secrets
    text = " ".join(f"{i:020x}" for i in range(50_000))
    got, took = seconds(spark, find_secrets, text)
    assert len(got.base) == 50_000 and got.live == [] and took < 30


def test_base_spans_between_tokens(spark):
    from upkeep.llm.secrets import find_secrets
    text = " ".join(f"Q{i:05d}zZxYwVuTsRqPoN{i} password={i:012d}" for i in range(5_000))
    got, took = seconds(spark, find_secrets, text)
    assert len(got.base) == 5_000 and len(got.live) == 5_000 and took < 30


@pytest.mark.parametrize("n", [50_000])
def test_alternating_quote_lines(spark, n):
    from upkeep.llm.quotes import link_quotes
    text = "\n".join("> " * (1 + i % 2) + f"line {i}" for i in range(n))
    got, took = seconds(spark, link_quotes, text, "conv_id long, turn long, role string, text string",
                        lambda t: (1, 1, "user", t))
    assert got.n_quotes == n and took < 30


def test_capital_numerals_are_no_letters():
    from upkeep.llm.quality import MEASURES, measure
    got = dict(zip(MEASURES, measure("Ⅷ Ⓐ É A a 🅰".encode())))
    assert (got["n_upper"], got["n_letters"]) == (2, 3)


def test_rules_under_a_measures_name(spark):
    from upkeep.llm.quality import ledger
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    want = ledger(df).first().ledger
    assert ledger(df, name="n_words_and_n_lines").first()[-1] == want and ledger(df, name="n_words").first()[-1] == want
