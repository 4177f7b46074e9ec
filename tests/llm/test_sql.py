"""Queries with SQL against that SQL, on the small tables and on made-up quotes."""

import pytest

from tests.llm.conftest import SF


def _names():
    from upkeep.llm.queries import SQL
    return sorted(SQL)


@pytest.mark.parametrize("name", _names())
def test_matches_sql(spark, duck_small, name):
    from tools.check_oracle import compare
    from upkeep.llm.queries import QUERIES, SQL
    got = compare(spark, duck_small, SF, name, QUERIES[name], SQL[name])
    assert got.startswith("OK"), got


def test_quotes_match_sql(spark, tmpdir_path):
    """The given conversations hold no quotes; these do, nested and across conversations."""
    import random

    import duckdb

    from tools.check_oracle import compare
    from upkeep.llm.queries import QUERIES, SQL
    rnd, rows = random.Random(13), []
    lines = [f"line number {i} says {'abcdefgh'[i % 8]} thing" for i in range(25)] + ["ok", "", "Fine then."]
    for c in range(40):
        said: list[str] = []
        for t in range(rnd.randint(1, 9)):
            text = [rnd.choice(lines) for _ in range(rnd.randint(0, 3))]
            if said and rnd.random() < 0.7:
                source = rnd.choice(said).split("\n")
                cut = [f"> {x}" for x in source[rnd.randint(0, 1):]]
                text = rnd.choice([["On Monday, someone wrote:"], []]) + cut + text
            said.append("\n".join(text))
            rows.append((c, t, rnd.choice(["user", "assistant", None]), said[-1]))
    # a message that quotes a line and repeats it; only a later conversation says it otherwise
    rows += [(-1, 0, "user", "> a line that nobody else said\na line that nobody else said"), (90, 3, "user", "A line that nobody else said!"),
             (-2, 0, "user", "> said by three of them today"), (-2, 1, "user", "said by three of them today"),
             (91, 0, None, "Said by three of them today."), (92, 0, None, "said by three of them today")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{tmpdir_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmpdir_path}/conversations.parquet/*.parquet')")
    name = "op4_quotation_linking"
    got = compare(spark, con, tmpdir_path, name, QUERIES[name], SQL[name])
    assert got.startswith("OK"), got
    linked = dict(((c, t), n) for c, t, n in con.execute(f"SELECT conv_id, turn, n_linked FROM ({SQL[name]})").fetchall())
    assert sum(linked.values()) > 50 and linked[-1, 0] == 1 and linked[-2, 0] == 1


def test_secrets_match_sql(spark, tmpdir_path):
    """Values in nine and in ten documents of one owner, of three owners, base spans that cover tokens."""
    import random

    import duckdb

    from tools.check_oracle import compare
    from upkeep.llm.queries import QUERIES, SQL
    rnd, rows, n = random.Random(17), [], 0
    for copies, owners in [(9, 1), (10, 1), (11, 1), (9, 2), (10, 2), (2, 2), (3, 3), (1, 1)] * 6:
        value = "".join(rnd.choices("abcdefghijkmnpqrstuvwxyzABCDEF23456789", k=rnd.choice([12, 16, 24, 32])))
        for i in range(copies):
            text = rnd.choice([f"token={value}", f"bare {value} é🙂", f"see {value}; api_key: '{value}'", f"x {value.lower()} {value}"])
            rows.append((n, f"{text} 0123456789abcdef{n:04x}" if n % 4 == 0 else text, "en", f"o{i % owners}", 0))
            n += 1
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmpdir_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmpdir_path}/documents.parquet/*.parquet')")
    name = "op7_secret_scan"
    got = compare(spark, con, tmpdir_path, name, QUERIES[name], SQL[name])
    assert got.startswith("OK"), got
    live, example = con.execute(f"SELECT sum(n_live), sum(n_example) FROM ({SQL[name]})").fetchone()
    assert live > 30 and example > 30
