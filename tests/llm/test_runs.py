"""Periodic runs against a brute-force version over all periods, and the whole query against the contract."""

import hashlib
import random
import re
import time
import zlib

import pytest

from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, min_length=6, min_exponent=4):
    """For every period, the maximal stretches whose words that far apart are equal."""
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                out.setdefault((i, j - i + q), q)  # smallest period first
            i = j + (j == i)
    return sorted((s, n, q) for (s, n), q in out.items())


def row(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, texts):
    from upkeep.llm.runs import op13_periodic_runs
    got = {r[0]: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    short = {d: t for d, t in texts.items() if len(WORD.findall(t or "")) < 1_500}
    assert len(got) == len(texts) and len(short) > 150
    want = {d: row(d, t) for d, t in short.items()}
    assert {d: got[d] for d in short} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_planting_in_long_texts(spark, texts):
    """The planted words themselves, for every document."""
    from pyspark.sql import functions as F

    from upkeep.llm.runs import planted
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat_ws(" ", "text", F.reverse("text")).alias("text"))
    for r in planted(docs.select("doc_id", "text").union(more)).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0:
            d = r.doc_id % 10_000
            w = WORD.findall(texts[d] if r.doc_id < 10_000 else texts[d] + " " + texts[d][::-1])
            n, g = len(w), h // 10
            a = g % n if n else 0
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3), (12, 2), (1, 2)])
def test_random_words(limits):
    from upkeep.llm.runs import runs_of_texts
    rnd = random.Random(sum(limits))
    texts = []
    for _ in range(700):
        n = rnd.randint(0, 50)
        w = [str(rnd.randrange(rnd.choice([1, 2, 3, 6]))) for _ in range(n)]
        if n > 3 and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randint(1, 7)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        texts.append(w)
    for lo in range(0, 700, 70):  # many texts at once
        part = texts[lo:lo + 70]
        for w, (runs, _, _) in zip(part, runs_of_texts([" ".join(w).encode() for w in part], *limits)):
            assert runs == brute(w, *limits), w


def test_hostile_texts_end_soon():
    from upkeep.llm.runs import runs_of_texts
    x, y = "a", "ab"
    while len(y) < 50_000:
        x, y = y, y + x
    cases = [(["a"] * 100_000, [(0, 100_000, 1)]), ("b c d e f".split() * 20_000, [(0, 100_000, 5)]),
             (["a"] * 20_000 + ["b"] + ["a"] * 20_000, [(0, 20_000, 1), (20_001, 20_000, 1)]), (list(y), []),
             ([w for i in range(2_000) for w in [f"z{i}", *["a"] * (20 + i % 50)]], None)]
    for words, want in cases:
        began = time.time()
        runs, _, kept = runs_of_texts([" ".join(words).encode()])[0]
        assert time.time() - began < 20
        assert len(runs) == 2_000 if want is None else runs == want
        assert len(kept.split()) == len(words) - sum(n - q for _, n, q in runs)


def test_odd_rows(spark, odd, clash, empty):
    from upkeep.llm.runs import planted, with_runs
    got = with_runs(odd)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and got.columns == [*odd.columns, "repeats"]
    for d in (1, 2, 3):
        assert (by_id[d].repeats.runs, by_id[d].repeats.best, by_id[d].repeats.collapsed) == ([], None, "")
    assert by_id[1].text is None
    assert by_id[7].repeats.best.asDict() == {"start": 0, "length": 100_000, "period": 5}
    assert by_id[7].repeats.collapsed == "lorem ipsum dolor sit amet"
    more = with_runs(clash)
    assert more.count() == odd.count() and more.columns[:-1] == clash.columns
    assert with_runs(empty).count() == 0 and planted(empty).count() == 0
    assert planted(odd).count() == odd.count()
