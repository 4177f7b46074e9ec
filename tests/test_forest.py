"""Forests over one block: split search against brute force, nested settings, and no Spark ML forest on the driver."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from upkeep.operators import forest


def _gini_gain(y, w, right, classes):
    def part(sel):
        c = np.bincount(y[sel], w[sel], classes)
        return (c ** 2).sum() / c.sum() if c.sum() else 0.0
    everything = np.ones(len(y), bool)
    return part(right) + part(~right) - part(everything) if right.any() and not right.all() else 0.0


@pytest.mark.parametrize("zeros", [0.0, 0.7])
def test_the_root_split_is_the_best_one(zeros):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 1)).astype("f4") * (rng.random((300, 1)) >= zeros)
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.2).astype(int) + (x[:, 0] > 1)
    r, at = np.nonzero(x)
    bins, cuts = forest.binned(300, 1, r, at, x[r, at])
    assert len(cuts[0]) < forest.BINS and (bins[:, 0] == (x > cuts[0]).sum(axis=1)).all()
    feature, cut, child, share = forest.grow_tree(bins, y, 3, 1, np.random.default_rng(5))
    w = np.random.default_rng(5).poisson(1.0, 300).astype(float)
    kept = w > 0
    gains = [_gini_gain(y[kept], w[kept], bins[kept, 0] > c, 3) for c in range(len(cuts[0]))]
    assert feature[0] == 0 and child[0] == 1 and gains[cut[0]] == pytest.approx(max(gains))
    right = np.bincount(y[kept & (bins[:, 0] > cut[0])], w[kept & (bins[:, 0] > cut[0])], 3)
    assert np.allclose(share[2], right / right.sum())


def test_a_full_tree_keeps_no_mixed_leaf_that_a_feature_can_part():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 32, (400, 6)).astype(np.uint8), rng.integers(0, 4, 400)
    feature, _, child, share = forest.grow_tree(bins, y, 4, 60, np.random.default_rng(2))
    leaves = share[feature < 0]
    assert (leaves.max(axis=1) > 0.999).mean() > 0.95 and child.max() == len(feature) - 2


def test_drawn_features_differ():
    for width, k in ((2000, 45), (64, 8), (5, 3), (2, 2)):
        got = forest.draw_features(np.random.default_rng(0), 500, width, k)
        assert got.shape == (500, k) and (np.diff(np.sort(got, axis=1), axis=1) > 0).all() and got.max() < width
        assert len(np.unique(got)) == width


def test_smaller_settings_are_cuts_of_the_largest(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from upkeep.plans import models as M
    df = spark.range(600).select("id", array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i))).alias("features"),
                                 F.when(F.sin(F.col("id") * 3) > 0.2, "a").when(F.sin(F.col("id")) > 0, "b").otherwise("c").alias("t"))
    large = M.TargetForests.fit(df, ["t"], 25, 6)
    settings = [(25, 6), (4, 6), (22, 2)]
    got = large.predict_settings(df, settings).collect()
    for i, (n, d) in enumerate(settings):
        own = {r.id: r.pred_t for r in M.TargetForests.fit(df.repartition(5), ["t"], n, d).predict(df).collect()}
        assert {r.id: r.pred_t for r in got if r.setting == i} == own and len(own) == 600
    right = [r.pred_t == r.t for r in got if r.setting == 0]
    assert sum(right) > 0.9 * len(right)


def test_deep_forests_of_one_block_need_no_driver_forest(spark, monkeypatch):
    """Hundreds of thousands of nodes grew as objects on the driver, with a histogram each in every partition."""
    from upkeep.plans import models as M

    def none(*args, **kwargs):
        raise AssertionError("a forest grown level by level through the driver")

    monkeypatch.setattr(M, "RandomForestClassifier", none)
    pred = M.vector_model(spark, SF_SMALL, 21, 8)  # parameters of no other test: nothing is stored.collect()
    assert pred and all(r.predicted is not None for r in pred)


def test_more_rows_than_a_block_are_fitted_by_spark_ml(spark, monkeypatch):
    from upkeep.plans import models as M
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    rows = spark.range(80).selectExpr("id", "cast(id % 2 as string) as t", "array(cast(id % 2 as double), 1D) as e")
    from pyspark.ml.functions import array_to_vector
    rows = rows.withColumn("features", array_to_vector("e")).drop("e")
    found = M.TargetForests.fit(rows, ["t"], 5, 3)
    assert found.trees is None and all(r.pred_t == r.t for r in found.predict(rows).collect())


def test_the_root_split_of_a_number_is_the_best_one():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 1)).astype("f4")
    y = np.where(x[:, 0] > 0.7, 5.0, 1.0) + rng.normal(size=400)
    bins, cuts = forest.binned(400, 1, *np.nonzero(x), x[:, 0])
    feature, cut, child, value, gain = forest.grow_number_tree(np.asfortranarray(bins), y, 3, 3, np.random.default_rng(5))
    w = np.random.default_rng(5).poisson(1.0, 400).astype(float)

    def part(sel):
        return (w[sel] @ y[sel]) ** 2 / w[sel].sum() if w[sel].sum() else 0.0
    gains = [part(bins[:, 0] > c) + part(bins[:, 0] <= c) - part(w >= 0) for c in range(len(cuts[0]))]
    assert feature[0] == 0 and cut[0] == np.argmax(gains) and gain[0] == pytest.approx(max(gains))
    right = bins[:, 0] > cut[0]
    assert child[0] == 1 and value[2] == pytest.approx(w[right] @ y[right] / w[right].sum())


def test_values_beside_a_frequent_one_keep_their_own_bins():
    """As Spark ML's strides: a third of the rows at zero must not merge the rare values next to it."""
    x = np.repeat(np.arange(1, 101), 20).astype("f4")
    cuts = forest.stride_cuts(x, 1000)
    assert len(cuts) < forest.BINS and list(cuts[:10]) == [i + 0.5 for i in range(10)] and cuts[-1] > 90
    assert list(forest.stride_cuts(x[x < 20], 5)) == [i + 0.5 for i in range(19)]


def test_lifespan_forest_of_one_block_needs_no_driver_forest(spark, monkeypatch):
    """All trees grew level by level over all rows, with a histogram per open node in every partition."""
    from pyspark.sql import functions as F
    from upkeep.plans import models as M

    def none(*args, **kwargs):
        raise AssertionError("a forest grown level by level through the driver")

    monkeypatch.setattr(M, "RandomForestRegressor", none)
    importance, feats, days = M._lifespan_fit(spark, SF_SMALL, 31, 7)  # parameters of no other test: nothing is stored
    error, flat = days.filter("is_train").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))), F.stddev("actual")).first()
    assert error < flat / 2 and abs(sum(importance()) - 1) < 1e-9 and len(importance()) == len(feats)


def test_more_rows_than_the_old_block_grow_in_the_tasks(spark, monkeypatch):
    """82,000 vectors were too many for a block and went to Spark ML, at any depth."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from upkeep.plans import models as M
    monkeypatch.setattr(M, "RandomForestClassifier", None)
    rows = spark.range(82_000).select(array_to_vector(F.array(*[F.sin(F.col("id") * i) for i in (1, 2)])).alias("features"),
                                      F.when(F.sin("id") > 0, "a").otherwise("b").alias("t"))
    held = rows.limit(300).withColumn("id", F.monotonically_increasing_id())
    found = M.TargetForests.fit(rows, ["t"], 4, 5)
    both = found.predict_settings(held, [(4, 5), (2, 1)]).select("id", "setting", "pred_t")
    # the trees that are used where they are grown are those that are written
    again = M.TargetForests.settings_of(rows, held, ["t"], [(4, 5), (2, 1)]).select("id", "setting", "pred_t")
    assert both.count() == 600 and both.exceptAll(again).count() == 0
    assert found.predict(held).filter("pred_t = t").count() > 290


def test_small_and_large_nodes_find_the_same_splits(monkeypatch):
    """Nodes one by one, by histograms or by their entries, in batches of any size; rows or features next to each other."""
    rng = np.random.default_rng(6)
    x = (rng.integers(0, 32, (900, 9)) * (rng.random((900, 9)) < 0.5)).astype(np.uint8)
    y = (x[:, 0] > 12).astype(int) + (x[:, 3] > x[:, 4])
    trees = []
    for one, batch, order in ((1, 1 << 20, "F"), (1, 1 << 20, "C"), (1 << 30, 1 << 20, "F"), (1 << 30, 64, "C"), (200, 500, "F")):
        monkeypatch.setattr(forest, "ONE_NODE", one)
        monkeypatch.setattr(forest, "BATCH", batch)
        trees.append(forest.grow_tree(np.asarray(x, order=order), y, 3, 4, np.random.default_rng(8)))
    for t in trees[1:]:
        assert len(t[0]) == len(trees[0][0]) and np.allclose(t[3], trees[0][3])
