"""Boosted trees, stored models, guards on empty training tables, the run log."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def moons(spark):
    """Three classes by two numbers and a code, some values missing, one combination very common."""
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        a, b, c = rnd.normal(), rnd.normal(), int(rnd.integers(4))
        y = "x" if a * b > 0.2 else "y" if a + c > 1 else "z"
        rows.append((i, float(a) if i % 17 else None, float(b), c, y if rnd.random() > 0.05 else "z"))
    rows += [(2000 + i, 3.0, 3.0, 1, "x") for i in range(900)]
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y string").cache()


def accuracy(df):
    return df.agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0]


def test_one_block_and_many_give_the_same_trees(spark, moons, monkeypatch):
    from upkeep.operators import boosting as B
    s = B.Settings(rounds=12, depth=3, min_hessian=1.0)
    one = B.fit(moons, ["a", "b", "c"], "y", s, one_block=True)
    monkeypatch.setattr(B, "BLOCK_CELLS", 200)
    many = B.fit(moons.repartition(3), ["a", "b", "c"], "y", s, one_block=False)
    assert (one.trees.feature == many.trees.feature).all() and (one.trees.cut == many.trees.cut).all()
    assert np.allclose(one.trees.value, many.trees.value) and one.cuts == many.cuts
    again = B.BoostedTrees.from_table(one.to_table(spark))
    a = one.predict(moons).select("id", "predicted")
    assert a.exceptAll(again.predict(moons).select("id", "predicted")).count() == 0
    assert abs(sum(one.importance().values()) - 1) < 1e-9


def test_histograms_equal_brute_force():
    from upkeep.operators import boosting as B
    rnd = np.random.default_rng(2)
    n, k, f, n_bins, s = 60, 3, 2, 5, B.Settings(rows=1.0, depth=2)
    bins, counts = rnd.integers(0, n_bins, (n, f)), rnd.integers(0, 4, (k, n)).astype(float)
    margins, keys = rnd.normal(size=(k, n)), np.arange(n, dtype=np.uint64)
    trees = B.Trees.empty(k, 2)
    trees.feature[:2, 0], trees.cut[:2, 0] = 1, 2  # the third tree is a leaf
    got = B.histogram(bins, counts, keys, margins, trees, 1, n_bins, s, 0)
    want = np.zeros((2, k, 2, f, n_bins))
    for i in range(n):
        p = np.exp(margins[:, i]) / np.exp(margins[:, i]).sum()
        for c in range(2):
            for j in range(f):
                node = int(bins[i, 1] > 2)
                want[0, c, node, j, bins[i, j]] += sum(counts[:, i]) * p[c] - counts[c, i]
                want[1, c, node, j, bins[i, j]] += 2 * sum(counts[:, i]) * p[c] * (1 - p[c])
    assert np.allclose(got, want)


def test_boosting_agrees_with_one_vs_rest(spark, moons):
    """Accuracy on held-out rows within 0.04 of one-vs-rest boosted trees of the same size."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, VectorAssembler

    from upkeep.operators import boosting as B
    train, test = moons.filter("id % 5 > 0"), moons.filter("id % 5 = 0")
    mine = accuracy(B.fit(train, ["a", "b", "c"], "y", B.Settings(rounds=15, depth=4, rate=0.3)).predict(test))
    indexer = StringIndexer(inputCol="y", outputCol="label")
    gbt = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, seed=1)
    model = Pipeline(stages=[Imputer(inputCols=["a"], outputCols=["a2"]), indexer,
                             VectorAssembler(inputCols=["a2", "b", "c"], outputCol="features"), OneVsRest(classifier=gbt)]).fit(train)
    theirs = accuracy(IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[1].labels).transform(model.transform(test)))
    assert mine > 0.8 and abs(mine - theirs) <= 0.04


def test_boosting_corner_cases(spark, moons):
    from upkeep.operators import boosting as B
    s = B.Settings(rounds=3, depth=2)
    one_class = B.fit(moons.filter("y = 'x'"), ["a", "b"], "y", s)
    assert one_class.predict(moons).select("predicted").distinct().collect()[0][0] == "x"
    unknown = moons.withColumn("b", F.lit(None).cast("double"))
    assert B.fit(unknown, ["a", "b"], "y", s).predict(unknown.withColumn("bins", F.lit(1))).count() == moons.count()
    with pytest.raises(ValueError, match="y"):
        B.fit(moons.limit(0), ["a"], "y", s)
    assert B.fit(moons, ["a"], "y", s).predict(moons.limit(0)).count() == 0


def test_store_fits_once_per_rows_and_parameters(spark, moons, tmpdir_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from upkeep.operators.model_store import Bundle, ModelStore
    store, fits = ModelStore(spark, f"{tmpdir_path}/models"), []

    def fit():
        fits.append(1)
        return Bundle({"p": Pipeline(stages=[VectorAssembler(inputCols=["b"], outputCol="v")]).fit(moons)},
                      {"t": moons.limit(3)}, {"score": 0.5})

    got = store.get_or_fit("kind", {"n": 1}, moons, fit)
    again = store.get_or_fit("kind", {"n": 1}, moons.repartition(7), fit)
    assert len(fits) == 1 and set(got.models) == {"p"} and again.tables["t"].count() == 3
    store.get_or_fit("kind", {"n": 2}, moons, fit)
    store.get_or_fit("kind", {"n": 1}, moons.withColumn("b", F.when(F.col("id") == 5, 0.0).otherwise(F.col("b"))), fit)
    store.get_or_fit("kind", {"n": 1}, moons.withColumnRenamed("a", "a2"), fit)
    assert len(fits) == 4
    log = spark.read.parquet(f"{tmpdir_path}/models/runs")
    assert log.filter("kind = 'metric' and key = 'score' and value = '0.5'").count() == 4
    assert sorted(r.value for r in log.filter("kind = 'param'").collect()) == ["1", "1", "1", "2"]
    store.save(fit(), store.path("kind", {"n": 1}, moons))  # the one that is there stays
    assert not [n for n in store._names(store.root) if n.count(".")]
    with pytest.raises(FileNotFoundError, match="save one first"):
        store.load(f"{tmpdir_path}/none")


@pytest.mark.parametrize("kind", ["interval", "boosted", "lifespan", "ticket", "vector", "text"])
def test_loaded_models_predict_like_fitted_ones(spark, monkeypatch, kind, tmpdir_path):
    from upkeep.operators import boosting as B
    from upkeep.operators.model_store import ModelStore
    from upkeep.plans import models as M, tickets
    kept = {}

    def get_or_fit(self, kind, params, train, fit):
        if "fitted" not in kept:
            kept["fitted"] = fit()
            self.save(kept["fitted"], f"{tmpdir_path}/m")
            return kept["fitted"]
        return self.load(f"{tmpdir_path}/m")

    def tickets_scored():
        vec, fitted, test = M._ticket_fit(spark, SF_SMALL, 5, 4, 200)
        return M.predict_tickets(vec, fitted, test).select("ticket_id", *[f"pred_{t}" for t in tickets.TARGETS])

    def boosted():
        model, test = M._boosted_fit(spark, SF_SMALL, B.Settings(rounds=5, depth=3))
        return model.predict(test).select("id", "predicted")

    def text():
        texts = tickets.with_targets(tickets.ticket_concat(spark, SF_SMALL))
        rows = M.fit_text_vectors(texts, 8, 2).transform(texts).select("ticket_id", "features", *tickets.TARGETS)
        return M._predict_targets(M._target_forests(spark, rows, 5, 4), rows)

    run = {"interval": lambda: M.interval_model(spark, SF_SMALL), "boosted": boosted, "ticket": tickets_scored,
           "lifespan": lambda: M._lifespan_fit(spark, SF_SMALL, 10, 4)[2].select("id", F.round("predicted", 9)),
           "text": text,
           "vector": lambda: M.vector_model(spark, SF_SMALL, 10, 4)}[kind]
    monkeypatch.setattr(ModelStore, "get_or_fit", get_or_fit)
    first = run().collect()
    second = run().collect()
    assert len(first) > 10 and sorted(map(tuple, first), key=str) == sorted(map(tuple, second), key=str)


def test_reports_from_the_fitted_forest(spark):
    from upkeep.plans import models as M
    worst = M.lifespan_worst_predictions(spark, SF_SMALL, 5).collect()
    errors = sorted((r.error for r in M._lifespan_tests(spark, SF_SMALL).collect()), reverse=True)
    assert sorted((r.error for r in worst), reverse=True) == errors[:5]
    assert M.lifespan_type_error(spark, SF_SMALL).first().n > 0
    ranks = M.lifespan_feature_importance(spark, SF_SMALL).orderBy("rank").collect()
    assert abs(sum(r.importance for r in ranks) - 1) < 1e-6 and ranks[0].importance >= ranks[-1].importance
    assert M.lifespan_report_text(spark, SF_SMALL).filter("report like '%sisa umur%'").count() > 10


def test_empty_training_tables_are_named(spark):
    from upkeep.plans import models as M
    from upkeep.session import materialize
    from upkeep.sources import fixtures as fx
    for empty in (spark.range(5).filter("id > 9"), spark.range(0), spark.range(9).groupBy("id").count().filter("count > 1")):
        with pytest.raises(ValueError, match="no rows: these"):
            materialize(empty, require="these")
    assert materialize(spark.range(5), require="these").count() == 5
    tables = {"assets": fx.assets(spark, SF_SMALL).limit(0), "complaints": fx.complaints(spark, SF_SMALL),
              "schedule": fx.schedule(spark, SF_SMALL)}
    with pytest.raises(ValueError, match="labelled assets"):
        M.interval_model(spark, tables)


def test_text_vectors_are_means_of_word_vectors(spark):
    from upkeep.plans import models as M, tickets
    rows = [(1, "pump leak pump"), (2, "leak valve"), (3, "pump valve leak leak"), (4, "unseen"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "ticket_id long, input_teks string")
    model = M.fit_text_vectors(df, size=4, min_count=2, rows_per_part=4)
    words = {r.word: r.vector.toArray() for r in model.stages[-1].getVectors().collect()}
    assert set(words) == {"pump", "leak", "valve"}
    got = {r.ticket_id: r.features.toArray() for r in model.transform(df).collect()}
    assert np.allclose(got[1], (2 * words["pump"] + words["leak"]) / 3, atol=1e-6)
    assert np.allclose(got[2], (words["leak"] + words["valve"]) / 2, atol=1e-6)
    assert len(got) == 6 and not got[4].any() and not got[5].any()


def test_text_vector_model_and_grid(spark):
    from upkeep.plans import models as M, tickets
    train, test = M.text_vector_split(spark, SF_SMALL, 100)
    assert train.join(test, "ticket_id").count() == 0
    pred = M.text_vector_model(spark, SF_SMALL, 10, 4).collect()
    assert len(pred) == test.count() == pred[0].n_test
    right = [all(r[t] == r[f"pred_{t}"] for t in tickets.TARGETS) for r in pred]
    assert abs(pred[0].exact_match - sum(right) / len(right)) < 1e-6
    grid = M.text_vector_grid(spark, SF_SMALL, (3, 6), (2, 4), folds=2).collect()
    assert [(r.num_trees, r.max_depth) for r in grid] == [(3, 2), (3, 4), (6, 2), (6, 4)]
    best = [r for r in grid if r.best]
    assert len(best) == 1 and best[0].mean_exact_match == max(r.mean_exact_match for r in grid)
    assert [r.test_exact_match is not None for r in grid] == [r.best for r in grid]


def test_ticket_grid_refits_the_best(spark):
    from upkeep.plans import models as M
    grid = M.ticket_grid(spark, SF_SMALL, folds=2, vocab_sizes=(50,), tree_counts=(2, 4), depths=(3,)).collect()
    assert [(r.max_features, r.num_trees, r.max_depth) for r in grid] == [(50, 2, 3), (50, 4, 3)]
    best = [r for r in grid if r.best]
    assert len(best) == 1 and best[0].mean_exact_match == max(r.mean_exact_match for r in grid)
    assert 0 <= best[0].test_exact_match <= 1 and [r.test_exact_match is None for r in grid] == [not r.best for r in grid]


class _Probe(Estimator):
    """Notes how many partitions the training rows have, then stops the training."""
    seen: list = []

    def _fit(self, dataset):
        self.seen.append(dataset.rdd.getNumPartitions())
        raise InterruptedError


@pytest.mark.parametrize("query, forest", [("interval_feature_importance", "interval_estimator"),
                                           ("lifespan_feature_importance", "RandomForestRegressor")])
def test_training_rows_of_a_task_are_bounded(spark, monkeypatch, query, forest):
    """The partitions of a forest's training rows follow their number."""
    from upkeep.plans import models as M
    monkeypatch.setattr(M, "TRAIN_ROWS", 10)
    monkeypatch.setattr(M, forest, lambda *a, **k: _Probe())
    monkeypatch.setattr(M.ModelStore, "exists", lambda self, path: False)
    with pytest.raises(InterruptedError):
        getattr(M, query)(spark, SF_SMALL)
    assert _Probe.seen.pop() > 8


def test_a_level_over_blocks_is_one_job_without_shuffle(spark, moons, monkeypatch):
    from upkeep.operators import boosting as B
    monkeypatch.setattr(B, "BLOCK_CELLS", 200)
    stages, tracker = [], spark.sparkContext.statusTracker()
    sums = B._Blocks.sums

    def counted(self, trees, level, n_bins, number):
        spark.sparkContext.setJobGroup(f"level-{number}-{level}", "one level")
        out = sums(self, trees, level, n_bins, number)
        jobs = tracker.getJobIdsForGroup(f"level-{number}-{level}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if number and level:
            stages.append([len(tracker.getJobInfo(j).stageIds) for j in jobs])
        assert out.shape[3] == (1 if level == self.s.depth else 3)
        return out

    monkeypatch.setattr(B._Blocks, "sums", counted)
    B.fit(moons, ["a", "b", "c"], "y", B.Settings(rounds=3, depth=3, min_hessian=1.0), one_block=False)
    assert stages and all(len(s) == 1 for s in stages)
