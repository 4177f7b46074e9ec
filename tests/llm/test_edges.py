"""Every dealt operator and pipeline stage on odd rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF

ALL = ["pii", "toxicity", "decontaminate", "token_files", "simhash", "secrets", "bpe", "line_dedup", "quality"]


def apply(name, spark, df):
    import public_tokenizers as P

    from upkeep.llm import (bpe, decontaminate, line_dedup, pii, quality, secrets, simhash, token_files,
                            toxicity)
    from upkeep.session import Scratch
    if name == "pii":
        return pii.find_personal_data(df)
    if name == "toxicity":
        return toxicity.score_toxicity(df, spark.read.parquet(f"{SF}/labels.parquet"))
    if name == "decontaminate":
        return decontaminate.with_leaks(df, spark.read.parquet(f"{SF}/benchmark.parquet"))
    if name == "token_files":
        path = Scratch(spark).new_path()
        token_files.write_token_files(df, path, P.path("word_bpe_49k.json"))
        return token_files.read_token_files(spark, path)
    if name == "simhash":
        return simhash.near_duplicates(df)
    if name == "secrets":
        return secrets.find_secrets(df)
    if name == "bpe":
        return bpe.encode_documents(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded=True, offsets=True)
    if name == "line_dedup":
        return line_dedup.dedup_lines(df)
    return quality.ledger(df)


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_keep_their_number(spark, odd, clash, empty, name):
    n = odd.count()
    got = apply(name, spark, odd)
    assert got.count() == n and "doc_id" in got.columns
    more = apply(name, spark, clash)
    assert more.count() == n
    none = apply(name, spark, empty)
    assert none.count() == 0 and none.columns == got.columns


def test_clashing_columns_pass_through(spark, clash):
    for name in ("decontaminate", "line_dedup", "quality"):
        got = apply(name, spark, clash)
        kept = [c for c in clash.columns if c != "text"]
        assert got.columns[:len(clash.columns)] == clash.columns and len(set(map(str.lower, got.columns))) == len(got.columns)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(kept).collect())) == sorted(map(key, clash.select(kept).collect()))


def test_null_and_empty_results(spark, odd):
    pii = {r.doc_id: r for r in apply("pii", spark, odd.filter("doc_id in (1, 2, 3)")).collect()}
    assert all(r.base == [] and r.extra == [] for r in pii.values())
    led = {r.doc_id: r.ledger for r in apply("quality", spark, odd.filter("doc_id in (1, 2, 3)")).collect()}
    assert all(x.n_words == 0 and x.fail_bits == 1 for x in led.values())
    sim = {(r.doc_id, r.fp): r for r in apply("simhash", spark, odd).collect()}
    assert {r.component_id for r in sim.values() if r.fp == 0} == {1}
    lines = {r.doc_id: r for r in apply("line_dedup", spark, odd.filter("doc_id in (1, 2, 3)")).collect()}
    assert lines[1].text is None and lines[2].text == "" and lines[3].lines.n_dropped == 0
    tox = [r.score for r in apply("toxicity", spark, odd).collect()]
    assert all(0 <= s <= 1 for s in tox)
    ids = {r.doc_id: r.ids for r in apply("token_files", spark, odd.filter("doc_id in (1, 2)")).collect()}
    assert ids == {1: [2], 2: [2]}


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, clash, empty, k):
    import corpus_pipeline
    name, stage = corpus_pipeline.STAGES[k]
    for df in (odd, clash, empty):
        got = stage(spark, df, SF)
        if k < 4:
            assert got.columns == df.columns
        assert got.count() <= df.count()


def test_stages_follow_the_brief():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup",
                                                      "decontamination", "byte_bpe"]


def test_messages(spark):
    from upkeep.llm.quotes import link_quotes
    rows = [(None, None, None, None), (None, 1, "user", "> hello there you all"), (1, None, "user", "hello there you all"),
            (1, 0, None, ""), (1, 0, "user", "hello there you all"), (1, 0, "user", "hello there you all"),
            (1, 1, "user", ">" * 50_000 + " deep"), (1, 2, "user", "> hello there you all\n" * 3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    got = link_quotes(df)
    assert got.count() == len(rows)
    last = got.filter("turn = 2").first()
    assert last.n_quotes == 1 and last.n_linked == 1 and last.parent_turn == 0 and last.path == [0, 2] and last.text == ""
    assert link_quotes(df.limit(0)).count() == 0


def test_packing_a_segment_takes_little_memory():
    """op5: six workers share an executor, so one segment's packing must stay small."""
    import tracemalloc

    import numpy as np
    from upkeep.llm import simple8b, token_files
    values = np.arange(token_files.SEGMENT_IDS) * 7919 % 49152
    tracemalloc.start()
    data = simple8b.encode(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (simple8b.decode(data) == values).all()
    assert peak < 24 << 20
