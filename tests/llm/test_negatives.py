"""Hard negatives against brute force: ties, hot directions, odd rows; and the certified stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute(rows, n_pos=5, n_neg=10, low=30, high=90):
    """rows: (vec_id, label, vector of Python ints); anchors are divisible by 10."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in rows:
        if a % 10:
            continue
        scored = sorted((-dot(va, v), i, la == lab) for i, lab, v in rows if i != a)
        for ps, p, _ in [x for x in scored if x[2]][:n_pos]:
            near = [(s, i) for s, i, same in scored if not same and low * -ps <= 100 * -s <= high * -ps][:n_neg]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **kw):
    from upkeep.llm.negatives import mine_negatives
    df = spark.createDataFrame(rows, "vec_id long, label long, q array<long>")
    return sorted(map(tuple, mine_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


def test_random_vectors_with_ties(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, int(rnd.integers(3)), [int(x) for x in rnd.integers(-2, 4, 6)]) for i in range(600)]
    got = mined(spark, rows, tile=90)
    assert got == brute(rows) and len(got) > 500
    few = mined(spark, rows, tile=90, n_positives=2, n_negatives=3, low_percent=10, high_percent=50)
    assert few == brute(rows, 2, 3, 10, 50)


def test_hot_direction(spark):
    """A third of the rows are one vector, or nearly."""
    rnd = np.random.default_rng(3)
    hot = rnd.integers(-100, 100, 16)
    rows = [(i, int(rnd.integers(4)), [int(x) for x in (hot + rnd.integers(0, 2, 16) if i % 3 == 0 else rnd.integers(-100, 100, 16))])
            for i in range(900)]
    assert mined(spark, rows, tile=200) == brute(rows)


def test_parts_of_a_large_cluster(spark, monkeypatch):
    from upkeep.llm import negatives
    monkeypatch.setattr(negatives, "CHUNK", 7)
    rnd = np.random.default_rng(4)
    rows = [(i, i % 2, [int(x) for x in rnd.integers(1, 50, 5)]) for i in range(400)]
    assert mined(spark, rows, tile=150) == brute(rows)


@pytest.mark.parametrize("size", [1 << 20, 1 << 30])
def test_large_components_stay_exact(spark, size):
    rnd = np.random.default_rng(5)
    rows = [(i, i % 2, [int(x) for x in rnd.integers(-size, size, 3)]) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_are_an_error():
    from upkeep.llm.negatives import scores
    with pytest.raises(ValueError, match="64 bits"):
        scores(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))


def test_stops_are_certified_and_early():
    """Members near one direction never look at most of a list of scattered items."""
    from upkeep.llm.negatives import SharedList, _unit, scores, walk
    rnd = np.random.default_rng(6)
    centre = _unit(rnd.normal(size=(1, 8)))
    members = np.floor(256 * (centre + rnd.normal(size=(20, 8)) * 0.02)).astype(int)
    items = np.floor(256 * np.concatenate([rnd.normal(size=(20_000, 8)) * 0.3, centre + rnd.normal(size=(200, 8)) * 0.02])).astype(int)
    ids = np.arange(len(items))
    every = lambda m, i: np.ones((len(m), len(i)), bool)
    limits = np.iinfo(np.int64)
    r, s, i, computed = walk(members, SharedList(members, centre[0], items), items, ids, every, np.arange(20),
                             np.full(20, limits.min), np.full(20, limits.max), 5)
    assert computed < 0.2 * scores(members, items).size
    for m in range(20):
        all_ = scores(members[m:m + 1], items)[0]
        want = np.lexsort((ids, -all_))[:5]
        assert sorted(i[r == m]) == sorted(want) and sorted(s[r == m]) == sorted(all_[want])


def test_odd_rows(spark, tmpdir_path):
    from upkeep.llm.negatives import mine_negatives, op12_hard_negatives, quantised
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 0.5], 1), (0, None, 1), (10, [nan, 1.0], 1), (20, [inf, 1.0], 2), (30, [None, 1.0], 2), (40, [1.0, 1.0], None),
            (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.7, 0.2], 2), (3, [], 2), (4, [0.5], 2),
            (5, [0.0, 0.0], 1), (6, [-1.0, -1.0], 2), (200, [], 5), (300, [0.0, 0.0], 1), (8, [0.7, 0.2], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, lab, [int(np.floor(256 * np.float32(x))) for x in v]) for i, v, lab in dict.fromkeys(
        (i, tuple(v) if v is not None else None, lab) for i, v, lab in rows)
        if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = [x for x in brute(good)]
    assert want
    q = quantised(df)
    got = mine_negatives(q, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    clash = q.select(*[F.lit(7).alias(n) for n in ("tile", "chunk", "cluster", "is_anchor", "score", "positives", "ids", "n")], "*")
    assert sorted(map(tuple, mine_negatives(clash, F.col("vec_id") % 10 == 0).collect())) == want
    for few in (q.limit(0), q.filter("vec_id in (1, 2)"), q.filter("vec_id = 100")):
        assert mine_negatives(few, F.col("vec_id") % 10 == 0).count() == 0
    df.write.parquet(f"{tmpdir_path}/embeddings.parquet")
    assert op12_hard_negatives(spark, tmpdir_path).columns == got.columns
