"""TF-IDF against brute force, and what it groups by document."""

import math
import random
from collections import Counter

import pytest

from upkeep.operators import tfidf


def brute(texts, k, n_max):
    docs = {}
    for i, (text, _) in texts.items():
        toks = [t for t in text.split() if len(t) >= 2]
        docs[i] = Counter(toks + ([f"{a} {b}" for a, b in zip(toks, toks[1:])] if n_max > 1 else []))
    fitted = [i for i, (_, fit) in texts.items() if fit]
    cf, df = sum((docs[i] for i in fitted), Counter()), Counter(t for i in fitted for t in docs[i])
    vocab = sorted(cf, key=lambda t: (-cf[t], t))[:k]
    out = {}
    for i, c in docs.items():
        w = {t: c[t] * (math.log((1 + len(fitted)) / (1 + df[t])) + 1) for t in vocab if c[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): round(x / norm, 6) for t, x in w.items()})
    return out


@pytest.mark.parametrize("k, n_max", [(4, 2), (9, 2), (30, 2), (5, 1), (10_000, 2)])
def test_vocabulary_and_weights_equal_brute_force(spark, monkeypatch, k, n_max):
    """Many ties at the cutoff; the table by document holds vocabulary terms only (it held every n-gram before)."""
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "x"]
    texts = {i: (" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), i % 4 != 0) for i in range(24)}
    written, real = [], tfidf.materialize
    monkeypatch.setattr(tfidf, "materialize", lambda df: written.append(real(df)) or written[-1])
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in texts.items()], "id long, text string, fit boolean")
    got = {(r.id, r.term): r.tfidf for r in tfidf.tfidf_long(df, "id", "text", k, n_max, fit="fit").collect()}
    want = brute(texts, k, n_max)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    by_doc = [t for t in written if "tf" in t.columns]
    assert [t.select("term").distinct().count() for t in by_doc] == [len({t for _, t in want})]


def test_smaller_vocabularies_are_heads_of_one_count(spark, monkeypatch):
    """the cleanup ran three times a vectoriser and the terms were counted for each size anew."""
    from upkeep.plans import models as M
    cleaned, real = [], M.TicketCleaner._transform
    monkeypatch.setattr(M.TicketCleaner, "_transform", lambda self, df: cleaned.append(1) or real(self, df))
    rows = spark.createDataFrame([("pump leak pump",), ("leak valve",), ("pump leak valve seal",)], "input_teks string")
    words = M.ticket_words(rows)
    found = M.fit_tfidf_sizes(words, [2, 4])
    large = M.vectors_of_words(found[4], words).count()
    assert cleaned == [1] and large == 3
    assert found[2].stages[4].vocabulary == ["leak", "pump"] == found[4].stages[4].vocabulary[:2]
    assert list(found[2].stages[5].getScalingVec()) == list(found[4].stages[5].getScalingVec())[:2]
    assert M.fit_tfidf(rows, 2).transform(rows).select("features").first() is not None


def test_symbols_leave_the_same_blanks(spark):
    """Every blank of ``text.BLANKS`` stays, every other character goes, in runs and one by one."""
    from upkeep.functions import text as tx
    odd = "a" + "".join(tx.BLANKS) + "é9\U0001f600--b_​᠎Z1"
    got = spark.createDataFrame([(odd,)], "t string").select(tx.drop_non_letters("t").alias("x"), tx.symbols_to_blank("t").alias("y")).first()
    assert got.x == "a" + tx.BLANKS + "b" and got.y == "a" + tx.BLANKS + " 9   b    1"
