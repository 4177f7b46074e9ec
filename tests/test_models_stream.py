"""Models (statistical checks, persistence) and the streaming append job."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL


def test_interval_model_save_load_and_score(spark, tmpdir_path):
    from upkeep.plans import models
    from upkeep.plans.interval import asset_conditions
    model, codes, test = models.train_interval_model(spark, SF_MID, num_trees=20)
    imp = model.stages[-1].featureImportances.toArray()
    assert abs(imp.sum() - 1.0) < 1e-6
    pred = models._with_labels(model, model.transform(test))
    acc = pred.select(F.avg((F.col("frekuensi") == F.col("predicted")).cast("double"))).first()[0]
    majority = test.groupBy("frekuensi").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority
    models.save_interval_model(model, codes, tmpdir_path)
    m2, c2 = models.load_interval_model(spark, tmpdir_path)
    new = asset_conditions(spark, SF_SMALL)
    a = models.score_intervals(model, codes, new).select("id", "predicted")
    b = models.score_intervals(m2, c2, new).select("id", "predicted")
    assert a.exceptAll(b).count() == 0
    try:
        models.score_intervals(m2, c2, new.drop("umur_aset_tahun"))
        raise AssertionError("missing feature not detected")
    except ValueError as e:
        assert "umur_aset_tahun" in str(e)


def test_boosted_interval_model_small(spark):
    from upkeep.plans import models
    model, _, test = models.train_interval_model(spark, SF_SMALL, algorithm="gbt", num_trees=3,
                                                 max_depth=3)
    assert models._with_labels(model, model.transform(test)).count() == test.count()


def test_ticket_pipeline_scores_new_text(spark):
    from upkeep.plans import models, tickets
    rows = tickets.with_input(tickets.ticket_rows(spark, SF_SMALL))
    vec, fitted = models.train_ticket_models(rows, max_features=200, num_trees=10, max_depth=5)
    new = spark.createDataFrame([("the machine is broken and leaking",)], "input_teks string")
    out = models.predict_tickets(vec, fitted, new).first()
    assert all(out[f"pred_{t}"] is not None for t in tickets.TARGETS)


def test_stream_appends_each_file_once(spark, tmpdir_path):
    from upkeep.sources import fixtures as fx
    from upkeep.streaming.corpus_stream import start_append
    raw, sink, ck = (os.path.join(tmpdir_path, x) for x in ("raw", "sink", "ck"))
    os.makedirs(raw)
    resp = fx.responses(spark, SF_SMALL).orderBy("batch_id").limit(3).collect()
    for r in resp[:2]:
        with open(os.path.join(raw, f"b{r['batch_id']}.txt"), "w") as f:
            f.write(r["response_text"])
    start_append(spark, raw, sink, ck).awaitTermination()
    n1 = spark.read.parquet(sink).count()
    with open(os.path.join(raw, f"b{resp[2]['batch_id']}.txt"), "w") as f:
        f.write(resp[2]["response_text"])
    start_append(spark, raw, sink, ck).awaitTermination()
    n2 = spark.read.parquet(sink).count()
    start_append(spark, raw, sink, ck).awaitTermination()  # nothing new: nothing appended
    assert 0 < n1 < n2 == spark.read.parquet(sink).count()
    with pytest.raises(ValueError, match="another checkpoint"):
        start_append(spark, raw, sink, ck + "2")
    # resume from the real sink: what it holds is no longer queued
    from upkeep.plans.corpus import coverage_queue, queue_remaining
    case = coverage_queue(spark, SF_SMALL).first()
    done = spark.createDataFrame([(case.kategori, case.severity, case.penyebab, case.jenis_kerusakan)],
                                 "kategori_aset string, severity string, root_cause string, jenis_kerusakan string")
    assert queue_remaining(spark, SF_SMALL, done).count() == coverage_queue(spark, SF_SMALL).count() - 1


def test_tfidf_ml_form_equals_relational_form(spark):
    """the ML pipeline (counts x (Spark idf + 1), L2) gives the relational weights when
    the vocabulary holds every term (no frequency ties at a cutoff)."""
    from pyspark.ml.functions import vector_to_array
    from upkeep.operators.tfidf import tfidf_long
    from upkeep.plans import models, tickets
    rows = tickets.with_input(tickets.ticket_rows(spark, SF_SMALL))
    rel = tfidf_long(tickets.clean_teks(rows), "ticket_id", "clean_teks", max_features=1 << 20)
    vec = models.fit_tfidf(rows, max_features=1 << 20)
    vocab = vec.stages[4].vocabulary
    ml = (vec.transform(rows).select("ticket_id", F.posexplode(vector_to_array("features")).alias("i", "w"))
          .filter("w != 0"))
    terms = spark.createDataFrame(list(enumerate(vocab)), "i int, term string")
    ml = ml.join(terms, "i").select("ticket_id", "term", F.round("w", 6).alias("tfidf"))
    assert rel.exceptAll(ml).count() == 0 and ml.exceptAll(rel).count() == 0


def test_complaint_level_model(spark):
    """M2 at complaint level, few trees: metrics over the test part of the time split, and scores that
    beat the training mean."""
    from upkeep.plans import lifespan, models
    parts, feats, days = models.rul_fit(spark, SF_SMALL, num_trees=10, max_depth=6, group=4)
    s = lifespan.complaint_split(spark, SF_SMALL)
    assert days.count() == s.filter("not is_train").count() and len(feats) == 13
    mean = s.filter("is_train").agg(F.avg("target")).first()[0]
    mae, flat = days.agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))),
                         F.avg(F.abs(F.col("actual") - F.lit(mean)))).first()
    assert mae < flat
    assert [n for n, _ in parts] == [4, 4, 2] and abs(models.joined_importance(parts).sum() - 1) < 1e-9


def test_forest_in_groups_goes_on_after_a_failure(spark, monkeypatch):
    """Parts that were stored are not fitted again, and the joined prediction is the mean over all trees."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from upkeep.plans import models
    rnd = np.random.default_rng(5)
    data = [(float(3 * a + b), Vectors.dense([a, b])) for a, b in rnd.normal(size=(300, 2)).tolist()]
    rows = spark.createDataFrame(data, ["label", "features"])
    real, fits = models.RandomForestRegressor.fit, []

    def fit(self, df):
        if len(fits) == 2:
            raise RuntimeError("lost")
        fits.append(self.getNumTrees())
        return real(self, df)

    monkeypatch.setattr(models.RandomForestRegressor, "fit", fit)
    with pytest.raises(RuntimeError, match="lost"):
        models.fit_in_groups(rows, 10, 3, group=4, parallelism=1)
    assert fits == [4, 4]
    fits[:] = [0]
    parts = models.fit_in_groups(rows, 10, 3, group=4, parallelism=1)
    assert fits == [0, 2] and [n for n, _ in parts] == [4, 4, 2]
    trees = [t for _, m in parts for t in m.trees]
    got = models.joined_prediction(parts, rows).limit(20).collect()
    assert all(abs(r.prediction - np.mean([t.predict(r.features) for t in trees])) < 1e-9 for r in got)
    assert set(got[0].asDict()) == {"label", "features", "prediction"}


def test_augmented_tickets_keep_their_source(spark):
    from upkeep.plans import models, tickets
    rows = tickets.with_targets(tickets.with_input(tickets.ticket_rows(spark, SF_SMALL)))
    twice = models.augment_tickets(rows)
    assert twice.count() == 2 * rows.count()
    assert twice.select("ticket_id", *tickets.TARGETS).distinct().count() == rows.count()
