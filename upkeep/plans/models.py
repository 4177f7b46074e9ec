"""Model training and batch scoring with Spark ML.

Trees are trained distributed (one pass over the data per tree level); only fitted models,
importances and metrics reach the driver.  The training vectors are cached once per fit.
Categorical codes are plain numeric columns (no nominal metadata), so ``maxBins`` never
has to cover a category count.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IDF, IndexToString,
                                NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StringIndexer, VectorAssembler, Word2Vec)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import keyed
from upkeep.functions import text as tx
from upkeep.operators import boosting, forest, tfidf
from upkeep.operators.encoding import (apply_label_codes, apply_target_encoding, fit_label_codes,
                                       fit_target_encoding)
from upkeep.operators.evaluate import classification_report, exact_match_report, regression_report
from upkeep.operators.model_store import Bundle, ModelStore
from upkeep.plans import interval as ip
from upkeep.plans import lifespan as ls
from upkeep.plans import reports as rp
from upkeep.plans import tickets as tk
from upkeep.session import materialize
from upkeep.sources import fixtures as fx

SEED = 42
# Tree training: a larger node batch per pass over the data (fewer passes per level) and
# node ids cached with the rows instead of re-walking every tree each pass.
TREE_OPTS = {"maxMemoryInMB": 1024, "cacheNodeIds": True, "checkpointInterval": 10}
# Many small forests at once (grid search): node-id caching would checkpoint each of them.
GRID_TREE_OPTS = {"maxMemoryInMB": 256}
# Feature sets of a grid that are fitted at once.
GRID_SETS = 3
# Training rows of one task: a forest keeps an int per row and tree for the sample and one for the node, about
# 4 KB a row at 200 trees, so a task reads 200 MB however large the table is.
TRAIN_ROWS, TRAIN_ROW_BYTES = 50_000, 4096

# ---- M1 / M5: interval classifier --------------------------------------------------------
INTERVAL_NUMERIC = ["jumlah_komplain", "rata_severity", "umur_aset_tahun"]
INTERVAL_FEATURES = [f"{c}_code" for c in ip.LABEL_CAT_COLS] + INTERVAL_NUMERIC


def interval_estimator(algorithm: str = "rf", num_trees: int = 200, max_depth: int = 7):
    """Boosted trees as in the reference (200 rounds, depth 7, rate 0.1, child weight 3 as
    min rows per node, 0.8 row and column subsampling) one-vs-rest, or a random forest of
    the same size (one distributed pass per level for all trees)."""
    if algorithm == "gbt":
        gbt = GBTClassifier(maxIter=num_trees, maxDepth=max_depth, stepSize=0.1,
                            minInstancesPerNode=3, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", seed=SEED)
        return OneVsRest(classifier=gbt, parallelism=4)
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=3,
                                  subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
                                  **TREE_OPTS)


def interval_training(spark: SparkSession, sf_dir: str):
    """(codes, rows) of the stratified split: label codes fitted on the training part, applied to all."""
    split = materialize(ip.interval_split(spark, sf_dir), require="labelled assets of the interval model")
    codes = fit_label_codes(split.filter("is_train"), ip.LABEL_CAT_COLS)
    return codes, materialize(apply_label_codes(split, codes, ip.LABEL_CAT_COLS, unknown_code=0))


def fit_interval_pipeline(train: DataFrame, algorithm: str = "rf", num_trees: int = 200, max_depth: int = 7) -> PipelineModel:
    pipe = Pipeline(stages=[
        StringIndexer(inputCol="frekuensi", outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=INTERVAL_FEATURES, outputCol="features"),
        interval_estimator(algorithm, num_trees, max_depth)])
    train = compact(train, TRAIN_ROWS).cache()
    model = pipe.fit(train)
    train.unpersist()
    return model


def train_interval_model(spark: SparkSession, sf_dir: str, algorithm: str = "rf",
                         num_trees: int = 200, max_depth: int = 7):
    """Fit on the stratified training part.  Returns (PipelineModel, codes, test rows)."""
    codes, coded = interval_training(spark, sf_dir)
    model = fit_interval_pipeline(coded.filter("is_train"), algorithm, num_trees, max_depth)
    return model, codes, coded.filter(~F.col("is_train"))


def _with_labels(model: PipelineModel, pred: DataFrame) -> DataFrame:
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol="predicted",
                         labels=labels).transform(pred)


def _interval_fit(spark: SparkSession, source):
    """The stored forest of the source's labelled assets, and its test rows."""
    codes, coded = interval_training(spark, source)
    train = coded.filter("is_train")
    found = ModelStore(spark).get_or_fit("interval-forest", {"num_trees": 200, "max_depth": 7, "seed": SEED}, train,
                                         lambda: Bundle({"pipeline": fit_interval_pipeline(train)}, {"codes": codes}))
    return found.models["pipeline"], found.tables["codes"], coded.filter(~F.col("is_train"))


def interval_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: predicted interval for every test asset."""
    model, _, test = _interval_fit(spark, sf_dir)
    pred = _with_labels(model, model.transform(test))
    return pred.select("id", "frekuensi", "predicted")


def _ranked(spark: SparkSession, importance: dict[str, float]) -> DataFrame:
    rows = sorted(importance.items(), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def interval_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: feature importances of the interval forest, strongest first."""
    model, _, _ = _interval_fit(spark, sf_dir)
    return _ranked(spark, dict(zip(INTERVAL_FEATURES, model.stages[-1].featureImportances.toArray().tolist())))


def _boosted_fit(spark: SparkSession, source, settings: boosting.Settings = boosting.Settings()):
    """The stored boosted trees of the source's labelled assets (the reference's settings: 200 rounds, depth 7,
    rate 0.1, child weight 3, 0.8 of rows and columns), and its test rows."""
    codes, coded = interval_training(spark, source)
    train = coded.filter("is_train")

    def fit():
        trees = boosting.fit(train, INTERVAL_FEATURES, "frekuensi", settings)
        return Bundle(tables={"trees": trees.to_table(spark), "codes": codes})

    found = ModelStore(spark).get_or_fit("interval-boosted", vars(settings), train, fit)
    return boosting.BoostedTrees.from_table(found.tables["trees"]), coded.filter(~F.col("is_train"))


def interval_boosted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 as the reference has it: the boosted classifier's interval for every test asset."""
    model, test = _boosted_fit(spark, sf_dir)
    return model.predict(test.select("id", "frekuensi", *INTERVAL_FEATURES)).select("id", "frekuensi", "predicted")


def interval_boosted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 of the boosted classifier on the test part: per class, accuracy, macro and weighted rows."""
    return classification_report(materialize(interval_boosted_model(spark, sf_dir)), "frekuensi", "predicted")


def interval_boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: share of the boosted trees' splits by feature, strongest first."""
    return _ranked(spark, _boosted_fit(spark, sf_dir)[0].importance())


def save_interval_model(model: PipelineModel, codes: DataFrame, path: str) -> None:
    """Pipeline and encoder table side by side."""
    model.write().overwrite().save(os.path.join(path, "pipeline"))
    codes.write.mode("overwrite").parquet(os.path.join(path, "codes"))


def load_interval_model(spark: SparkSession, path: str):
    try:
        codes = spark.read.parquet(os.path.join(path, "codes"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no interval model at {path}; train and save one first") from e
    return PipelineModel.load(os.path.join(path, "pipeline")), codes


def score_intervals(model: PipelineModel, codes: DataFrame, assets: DataFrame) -> DataFrame:
    """M5: batch scoring.  P13 every fitted feature must be present (the missing ones are
    named); P14 features are assembled in the fitted order; unseen categories get code 0
    and a missing value reads as the text 'nan', as in the reference's scoring script."""
    needed = ip.LABEL_CAT_COLS + INTERVAL_NUMERIC
    missing = [c for c in needed if c not in assets.columns]
    if missing:
        raise ValueError(f"input lacks required features: {missing}")
    coded = apply_label_codes(assets, codes, ip.LABEL_CAT_COLS, missing_text="nan",
                              unknown_code=0)
    # the label indexer is only needed in training; the rest of the pipeline scores
    scorer = PipelineModel(stages=model.stages[1:])
    return _with_labels(model, scorer.transform(coded))


# ---- M2: lifespan regression -----------------------------------------------------------
LIFESPAN_NUMERIC = ["total_komplain", "severity_mean", "severity_max", "biaya_total_log",
                    "biaya_mean_log", "hari_antar_komplain_mean"]


def _lifespan_fit(spark: SparkSession, sf_dir: str, num_trees: int, max_depth: int):
    """A function that gives the importances of the stored forest on log1p(lifespan), the features, and every labelled asset scored in days (id,
    is_train, actual, predicted and the split's columns).  Where a task can hold all training rows as bins, whole trees are grown by
    the tasks (``operators.forest``), else Spark ML's go level by level over all rows."""
    s = ls.asset_split(spark, sf_dir, noise_scale=30.0)
    train = s.filter("is_train")
    feats = LIFESPAN_NUMERIC + [f"te_{c}" for c in ls.CAT_COLS]

    def vectors(df, enc):
        return apply_target_encoding(df, enc, ls.CAT_COLS).withColumn("label", F.log1p("target"))

    def fit():
        enc = fit_target_encoding(train, ls.CAT_COLS, "target")
        assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
        rows = materialize(vectors(train, enc), require="training assets of the lifespan model")
        if _fits_a_task(rows.count(), len(feats), max_depth):
            keyed_rows = assembler.transform(rows).withColumn("_key", F.xxhash64("id"))
            packed = forest.pieces(keyed_rows, "_key", ["label"], number=True)
            return Bundle(tables={"trees": forest.fit_number(packed, num_trees, max_depth, 3, SEED), "encoding": enc})
        rf = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=3,
                                   featureSubsetStrategy="sqrt", seed=SEED, **TREE_OPTS)
        rows = compact(rows.select("label", *feats), TRAIN_ROWS).cache()
        model = Pipeline(stages=[assembler, rf]).fit(rows)
        rows.unpersist()
        return Bundle({"forest": model}, {"encoding": enc})

    found = ModelStore(spark).get_or_fit("lifespan-forest", {"num_trees": num_trees, "max_depth": max_depth, "seed": SEED,
                                                             "layout": 2}, train, fit)
    coded = vectors(s, found.tables["encoding"])
    if "trees" in found.tables:
        pred = coded.withColumn("prediction", forest.number_prediction(found.tables["trees"], feats))
        importance = lambda: forest.number_importance(found.tables["trees"])
    else:
        pred = found.models["forest"].transform(coded)
        importance = lambda: found.models["forest"].stages[-1].featureImportances.toArray().tolist()
    days = pred.withColumns({"actual": F.expm1("label"), "predicted": F.expm1("prediction")})
    return importance, feats, days.select(*s.columns, "actual", "predicted")


def _fits_a_task(rows: int, width: int, depth: int) -> bool:
    """Whether the memory of a task of TRAIN_ROWS rows holds a regression tree's rows (a byte a bin; label, weight, node, number of
    the row and what is sorted, 8 bytes each, at most ten at once) and histograms (count and sum of 32 bins of every node)."""
    return rows * (width + 80) + forest.BINS * 2 * 8 * 2 ** depth <= TRAIN_ROWS * TRAIN_ROW_BYTES


def lifespan_model(spark: SparkSession, sf_dir: str, num_trees: int = 250,
                   max_depth: int = 12) -> DataFrame:
    """M2 + F6 + E1-E5: forest on log1p(lifespan) (formula target with keyed N(0, 30)
    noise), 'sqrt' features, min split 6 -> 3 rows per node; metrics in days on the
    time-ordered test part."""
    _, _, days = _lifespan_fit(spark, sf_dir, num_trees, max_depth)
    days = materialize(days.filter(~F.col("is_train")).select("id", "actual", "predicted"))
    return regression_report(days, "actual", "predicted", key="id")


def lifespan_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: feature importances of the lifespan forest, strongest first."""
    importance, feats, _ = _lifespan_fit(spark, sf_dir, 250, 12)
    return _ranked(spark, dict(zip(feats, importance())))


def _lifespan_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, days = _lifespan_fit(spark, sf_dir, 250, 12)
    days = days.filter(~F.col("is_train")).withColumns({c: F.bround(c, 0) for c in ("actual", "predicted")})
    return days.withColumn("error", F.abs(F.col("predicted") - F.col("actual")))


def lifespan_worst_predictions(spark: SparkSession, sf_dir: str, k: int = 15) -> DataFrame:
    """M8 + O3 + J14: the k largest errors of the fitted forest on test assets, with display attributes."""
    return ls.worst_predictions(spark, sf_dir, k, _lifespan_tests(spark, sf_dir))


def lifespan_type_error(spark: SparkSession, sf_dir: str, tipe: str = "gear") -> DataFrame:
    """M8 + E9: the fitted forest's mean absolute error on test assets of one type."""
    return ls.type_slice_error(spark, sf_dir, tipe, _lifespan_tests(spark, sf_dir))


def lifespan_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the templated cost report of every labelled asset, its remaining days by the fitted forest."""
    _, _, days = _lifespan_fit(spark, sf_dir, 250, 12)
    return rp.asset_report_text(spark, sf_dir, predictions=days.drop("actual"))


def fit_in_groups(rows: DataFrame, num_trees: int, max_depth: int, group: int = 50, parallelism: int = 4) -> list:
    """A regression forest on ``label`` and ``features`` as (trees, part) of ``group`` trees each.  Every part
    has its own seed and is stored as soon as it is fitted, so a training that breaks off goes on
    with the parts that are missing."""
    store = ModelStore(rows.sparkSession)

    def part(first):
        n = min(group, num_trees - first)

        def fit():
            rf = RandomForestRegressor(numTrees=n, maxDepth=max_depth, seed=SEED + first, predictionCol=f"p_{first}",
                                       **GRID_TREE_OPTS)
            return Bundle({"forest": PipelineModel(stages=[rf.fit(rows)])})

        params = {"first": first, "trees": n, "max_depth": max_depth, "seed": SEED}
        return n, store.get_or_fit("remaining-life-forest", params, rows, fit).models["forest"].stages[0]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(part, range(0, num_trees, group)))


def joined_prediction(parts: list, df: DataFrame) -> DataFrame:
    """``prediction`` of the parts as one forest: the mean over all trees."""
    for _, m in parts:
        df = m.transform(df)
    total = sum(n for n, _ in parts)
    mean = sum((F.col(m.getPredictionCol()) * F.lit(n / total) for n, m in parts), F.lit(0.0))
    return df.withColumn("prediction", mean).drop(*[m.getPredictionCol() for _, m in parts])


def joined_importance(parts: list) -> list[float]:
    total = sum(n for n, _ in parts)
    return sum(m.featureImportances.toArray() * n for n, m in parts) / total


def rul_fit(spark: SparkSession, sf_dir: str, num_trees: int = 500, max_depth: int = 20, group: int = 50):
    """M2 at complaint level: forest on log1p of the real remaining life, fitted to the oversampled
    training part of the time split; features are the complaint history, log cost and target
    encodings.  Returns (parts of the forest, feature names, scored test rows in days)."""
    s = materialize(ls.complaint_split(spark, sf_dir), require="complaints of the remaining-life model")
    train = s.filter("is_train")
    enc = fit_target_encoding(train, ls.CAT_COLS, "target")
    feats = ls.COMPLAINT_NUMERIC + [f"te_{c}" for c in ls.CAT_COLS]
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")

    def vectors(df):
        coded = apply_target_encoding(df, enc, ls.CAT_COLS).fillna(0.0, subset=ls.COMPLAINT_NUMERIC)
        return va.transform(coded.withColumn("label", F.log1p("target"))).select(
            "id", "row_seq", "label", "features")

    fitted = compact(materialize(vectors(ls.oversample(train)))).cache()
    parts = fit_in_groups(fitted, num_trees, max_depth, group)
    fitted.unpersist()
    pred = joined_prediction(parts, vectors(s.filter(~F.col("is_train"))))
    days = pred.select("id", "row_seq", F.expm1("label").alias("actual"), F.expm1("prediction").alias("predicted"))
    return parts, feats, materialize(days)


def rul_model(spark: SparkSession, sf_dir: str, num_trees: int = 500, max_depth: int = 20) -> DataFrame:
    """M2 + E1-E5 + M7: the metrics in days on the test part, and the five strongest features."""
    parts, feats, days = rul_fit(spark, sf_dir, num_trees, max_depth)
    keyed_days = days.withColumn("key", F.concat_ws("|", "id", "row_seq"))
    top = sorted(zip(feats, joined_importance(parts).tolist()), key=lambda r: (-r[1], r[0]))[:5]
    return regression_report(keyed_days, "actual", "predicted", key="key").withColumn(
        "top_features", F.lit(",".join(n for n, _ in top)))


# ---- M3 / M4 / M6: ticket classifiers ----------------------------------------------------
class TicketCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                    DefaultParamsWritable):
    """The training-time cleanup as a pipeline stage, so scoring new text (M6) runs the very
    same expressions: strict cleanup, stop words, base forms.  The word tables are parameters and are
    saved with the stage."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop", TypeConverters.toListString)
    words = Param(Params._dummy(), "words", "words that have a base form", TypeConverters.toListString)
    bases = Param(Params._dummy(), "bases", "base forms of words, in order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol: str = "input_teks", outputCol: str = "clean_teks", stopWords=None,
                 words=None, bases=None):
        super().__init__()
        self._setDefault(stopWords=list(tk.STOP_WORDS), words=list(tk.LEMMAS),
                         bases=list(tk.LEMMAS.values()))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        strict = tx.strict_clean(F.col(self.getInputCol()))
        base_of = dict(zip(self.getOrDefault("words"), self.getOrDefault("bases")))
        toks = tx.map_words(tx.remove_words(tx.tokens(strict), self.getOrDefault("stopWords")), base_of)
        return df.withColumn(self.getOutputCol(), tx.join_tokens(toks))


def _word_stages() -> list:
    return [TicketCleaner(inputCol="input_teks", outputCol="clean_teks"),
            RegexTokenizer(inputCol="clean_teks", outputCol="uni", pattern=r"\S\S+", gaps=False, toLowercase=False)]


def ticket_words(df: DataFrame) -> DataFrame:
    """The rows with the words (``uni``) of their cleaned text, written: the cleanup runs once, however often they are read."""
    return materialize(PipelineModel(stages=_word_stages()).transform(df).drop("clean_teks", "input_teks"))


def fit_tfidf(train: DataFrame, max_features: int = 2000) -> PipelineModel:
    """F9 in ML form with scikit-learn's idf: counts x (Spark idf + 1), then L2 norm."""
    return fit_tfidf_sizes(ticket_words(train.select("input_teks")), [max_features])[max_features]


def fit_tfidf_sizes(words: DataFrame, sizes: list[int]) -> dict[int, PipelineModel]:
    """The vectorisers of several vocabulary sizes on written ``ticket_words``: the terms are counted once (ties by term),
    and a smaller vocabulary is the head of the largest one."""
    found, _ = tfidf.vocabulary(tfidf.neighbours(words, "uni"), max(sizes))
    vocab = [r.term for r in found.orderBy(F.desc("cf"), F.asc("term")).collect()]  # as many as the parameter says
    terms = [NGram(n=2, inputCol="uni", outputCol="bi"), SQLTransformer(statement="SELECT *, concat(uni, bi) AS terms FROM __THIS__")]

    def counter(size):
        return CountVectorizerModel.from_vocabulary(vocab[:size], "terms", "tf")

    counted = PipelineModel(stages=[*terms, counter(len(vocab))]).transform(words)
    idf = IDF(inputCol="tf", outputCol="_idf").fit(counted.select("tf")).idf.toArray()
    return {n: PipelineModel(stages=[
        *_word_stages(), *terms, counter(n),
        ElementwiseProduct(inputCol="tf", outputCol="tfidf_raw", scalingVec=DenseVector(idf[:n] + 1.0)),
        Normalizer(inputCol="tfidf_raw", outputCol="features", p=2.0)]) for n in sizes}


def vectors_of_words(vec: PipelineModel, words: DataFrame) -> DataFrame:
    """What the vectoriser makes of texts, from their written ``ticket_words``."""
    return PipelineModel(stages=vec.stages[2:]).transform(words)


def _fit_target(feats: DataFrame, target: str, num_trees: int, max_depth: int,
                opts: dict | None = None, idx=None):
    idx = idx or StringIndexer(inputCol=target, outputCol=f"y_{target}", handleInvalid="keep",
                               stringOrderType="alphabetAsc").fit(feats)
    rf = RandomForestClassifier(labelCol=f"y_{target}", featuresCol="features",
                                predictionCol=f"p_{target}", rawPredictionCol=f"raw_{target}",
                                probabilityCol=f"prob_{target}", numTrees=num_trees,
                                maxDepth=max_depth, seed=SEED, **(opts or TREE_OPTS))
    return idx, rf.fit(idx.transform(feats))


@dataclass
class TargetForests:
    """Forests of several targets on one vector column: ``trees`` with the ``classes`` of every target where the rows
    fitted one block (``operators.forest``), else Spark ML's ``stages`` (index, forest) of every target."""
    classes: dict[str, list] = field(default_factory=dict)
    trees: DataFrame | None = None
    stages: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def fit(rows: DataFrame, targets: list[str], num_trees: int, max_depth: int, parallelism: int = 4,
            opts: dict | None = None) -> "TargetForests":
        """``rows``: a written table of ``features`` and the targets."""
        classes, packed = TargetForests._packed(rows, targets)
        if packed is not None:
            return TargetForests(classes, forest.fit(packed, [len(classes[t]) for t in targets], num_trees, max_depth, SEED))
        dealt = compact(rows).cache()
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            got = list(pool.map(lambda t: _fit_target(dealt, t, num_trees, max_depth, opts), targets))
        dealt.unpersist()
        return TargetForests(stages=dict(zip(targets, map(list, got))))

    @staticmethod
    def _packed(rows: DataFrame, targets: list[str]):
        """(classes of every target, the rows as pieces; none where they are more than a block)."""
        classes = {t: [r[0] for r in rows.select(t).dropna().distinct().orderBy(t).collect()] for t in targets}  # few
        coded = rows.withColumns({t: F.array_position(F.array(*[F.lit(c) for c in classes[t]]), F.col(t)).cast("int") - 1
                                  if classes[t] else F.lit(-1) for t in targets}).fillna(-1, targets)
        packed = forest.pieces(coded.withColumn("_key", F.xxhash64(vector_to_array("features"), *targets)), "_key", targets)
        return classes, packed if forest.one_block(packed) and all(classes.values()) else None

    @staticmethod
    def settings_of(rows: DataFrame, held: DataFrame, targets: list[str], settings: list[tuple[int, int]]) -> DataFrame | None:
        """``predict_settings`` of the rows ``held`` by forests of ``rows`` that are not kept; None where the rows are more than
        a block."""
        classes, packed = TargetForests._packed(rows, targets)
        if packed is None:
            return None
        held = materialize(held.withColumn("_row", F.monotonically_increasing_id()))
        theirs = forest.pieces(held.withColumns({t: F.lit(-1) for t in targets}), "_row", targets)
        found = forest.fit_predict(packed, theirs, [len(classes[t]) for t in targets], settings, SEED)
        return TargetForests(classes)._named(held, found)

    def _named(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        names = {t: F.array(*[F.lit(str(c)) for c in cs]) for t, cs in self.classes.items()}
        said = found.groupBy("key", "setting").agg(*[
            F.get(names[t], F.max(F.when(F.col("target") == i, F.col("prediction")))).alias(f"pred_{t}")
            for i, t in enumerate(self.classes)])
        return rows.join(said, F.col("_row") == F.col("key")).drop("_row", "key")

    def bundle(self, **models: PipelineModel) -> Bundle:
        if self.trees is None:
            return Bundle({**models, **{t: PipelineModel(stages=pair) for t, pair in self.stages.items()}})
        rows = [(t, i, str(c)) for t, cs in self.classes.items() for i, c in enumerate(cs)]
        table = self.trees.sparkSession.createDataFrame(rows, "target string, code int, class string").coalesce(1)
        return Bundle(models, {"trees": self.trees, "classes": table})

    @staticmethod
    def of(bundle: Bundle, targets: list[str]) -> "TargetForests":
        if "trees" not in bundle.tables:
            return TargetForests(stages={t: bundle.models[t].stages for t in targets})
        rows = bundle.tables["classes"].orderBy("target", "code").collect()
        return TargetForests({t: [r[2] for r in rows if r[0] == t] for t in targets}, bundle.tables["trees"])

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pred_`` columns, as text."""
        if self.trees is not None:
            return self.predict_settings(rows, [(1 << 30, 1 << 30)]).drop("setting")
        kept = rows.columns
        for t, (idx, model) in self.stages.items():
            rows = IndexToString(inputCol=f"p_{t}", outputCol=f"pred_{t}",
                                 labels=idx.labels + ["__unseen__"]).transform(model.transform(rows))
        return rows.select(*kept, *[f"pred_{t}" for t in self.stages])

    def predict_settings(self, rows: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
        """``rows`` once for every setting (first trees, greatest depth) that the fitted trees hold, with its number in
        ``setting`` and ``pred_`` columns."""
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
        return self._named(rows, forest.predict(self.trees, forest.pieces(rows, "_row"), settings))


def augment_tickets(train: DataFrame) -> DataFrame:
    """Every training ticket and a copy with synonyms substituted in its cleaned text; the copy
    keeps the source's id, targets and fold."""
    text = F.col("input_teks")
    both = F.array(text, tx.replace_words(tx.strict_clean(text), tk.SYNONYMS))
    return train.withColumn("input_teks", F.explode(both))


def compact(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """Rows for tree training in one partition per core, or more where their number needs it: every
    level of every tree is a job over all partitions."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task)))


def train_ticket_models(train: DataFrame, max_features: int = 2000, num_trees: int = 200,
                        max_depth: int = 30, parallelism: int = 4):
    """M3: one forest per target on one written feature vector."""
    words = ticket_words(train.select("input_teks", *tk.TARGETS))
    vec = fit_tfidf_sizes(words, [max_features])[max_features]
    feats = materialize(vectors_of_words(vec, words).select("features", *tk.TARGETS))
    return vec, TargetForests.fit(feats, tk.TARGETS, num_trees, max_depth, parallelism)


def predict_tickets(vec: PipelineModel, fitted: TargetForests, df: DataFrame) -> DataFrame:
    """M6: new text goes through the fitted cleanup + vectoriser, then every forest."""
    return fitted.predict(vec.transform(df).select(*df.columns, "features"))


def _ticket_fit(spark: SparkSession, sf_dir: str, num_trees: int = 200, max_depth: int = 30, max_features: int = 2000):
    """The stored vectoriser and forests of the source's augmented training tickets, and its test tickets."""
    s = tk.with_targets(tk.with_input(tk.ticket_rows(spark, sf_dir)))
    s = s.withColumn("is_train", keyed.uniform("ticket_id", seed=SEED) < F.lit(0.8))
    train = materialize(augment_tickets(s.filter("is_train")), require="training tickets")

    def fit():
        vec, fitted = train_ticket_models(train, max_features, num_trees, max_depth)
        return fitted.bundle(vectoriser=vec)

    params = {"num_trees": num_trees, "max_depth": max_depth, "max_features": max_features, "seed": SEED, "layout": 2}
    found = ModelStore(spark).get_or_fit("ticket-forests", params, train.select("input_teks", *tk.TARGETS), fit)
    return found.models["vectoriser"], TargetForests.of(found, tk.TARGETS), s.filter(~F.col("is_train"))


def ticket_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + E6/E7 + F11: four forests (200 trees; depth 30 is Spark's "unlimited") on TF-IDF of the
    augmented training part; predictions for the test tickets, beside them the exact match and the
    accuracy of each target over all of them."""
    vec, fitted, test = _ticket_fit(spark, sf_dir)
    pred = predict_tickets(vec, fitted, test)
    pred = materialize(pred.select("ticket_id", *tk.TARGETS, *[f"pred_{t}" for t in tk.TARGETS]))
    report = exact_match_report(pred, [(t, f"pred_{t}") for t in tk.TARGETS])  # one row
    return pred.join(F.broadcast(report.withColumnRenamed("n", "n_test")))


def grid_scores(train: DataFrame, held: DataFrame, settings: list[tuple[int, int]]) -> list[float]:
    """Exact match over ``held`` of forests of every (trees, depth) fitted to ``train`` (tables of features and targets).
    A tree's draws depend on its number and level alone, so the trees of the largest setting hold those of every
    other one; with Spark ML every setting is fitted apart."""
    pairs = [(t, f"pred_{t}") for t in tk.TARGETS]
    said = TargetForests.settings_of(train, held, tk.TARGETS, settings)
    if said is not None:
        said = materialize(said.select("setting", *[c for p in pairs for c in p]))
        predicted = [said.filter(F.col("setting") == i) for i in range(len(settings))]
    else:
        predicted = [TargetForests.fit(train, tk.TARGETS, *x, opts=GRID_TREE_OPTS).predict(held) for x in settings]
    return [float(exact_match_report(p, pairs).first()["exact_match"] or 0.0) for p in predicted]


def ticket_grid(spark: SparkSession, sf_dir: str, folds: int = 3,
                vocab_sizes=(1000, 2000), tree_counts=(100, 200), depths=(30, 10, 20),
                parallelism: int = 8) -> DataFrame:
    """M4: grid search with keyed folds (fold = hash of the source ticket, so augmented
    twins never straddle folds); the score is the joint exact match over four targets,
    which is why the loop is explicit (CrossValidator scores one target).  Forests are fitted to
    augmented tickets and scored on original ones.  The best setting (then the smallest) is fitted again
    to the whole training part; its row has the exact match over the test tickets.  Depth 30 is
    Spark's maximum and stands for 'unlimited'."""
    s = tk.with_targets(tk.with_input(tk.ticket_rows(spark, sf_dir)))
    s = s.withColumn("is_train", keyed.uniform("ticket_id", seed=SEED) < F.lit(0.8)) \
         .withColumn("fold", F.floor(keyed.uniform("ticket_id", F.lit("fold"), seed=SEED)
                                     * folds).cast("int"))
    s = materialize(s, require="tickets of the grid")
    s, test = s.filter("is_train"), s.filter("not is_train")
    # feature sets per (fold, vocabulary size); the forests of all settings on one set come from one training
    named = ["ticket_id", "input_teks", *tk.TARGETS, "fold"]
    twice, once = ticket_words(augment_tickets(s.select(named))), ticket_words(s.select(named))
    sets = {}
    for f in range(folds):
        tr, va = twice.filter(F.col("fold") != f), once.filter(F.col("fold") == f)
        for v, vec in fit_tfidf_sizes(tr, list(vocab_sizes)).items():
            sets[(f, v)] = (vec, tr, va)
    settings = [(n, d) for n in tree_counts for d in depths]

    def score(key):
        vec, tr, va = sets[key]
        return grid_scores(*(materialize(vectors_of_words(vec, x).select("features", *tk.TARGETS)) for x in (tr, va)), settings)

    with ThreadPoolExecutor(max_workers=min(parallelism, GRID_SETS)) as pool:
        scored = dict(zip(sets, pool.map(score, sets)))
    results = [(v, n, d, f, x) for (f, v), xs in scored.items() for (n, d), x in zip(settings, xs)]
    mean: dict[tuple, float] = {}
    for *setting, _, score in results:
        mean[tuple(setting)] = mean.get(tuple(setting), 0.0) + score / folds
    best = min(mean, key=lambda k: (-mean[k], *k))
    vec, refit = train_ticket_models(materialize(augment_tickets(s)), *best)
    final = exact_match_report(predict_tickets(vec, refit, test), [(t, f"pred_{t}") for t in tk.TARGETS]).first()
    rows = [(*k, x, k == best, float(final["exact_match"] or 0.0) if k == best else None) for k, x in sorted(mean.items())]
    return spark.createDataFrame(rows, "max_features int, num_trees int, max_depth int, mean_exact_match double, "
                                       "best boolean, test_exact_match double")


# ---- F10: stored sentence vectors --------------------------------------------------------

def vector_model(spark: SparkSession, sf_dir: str, num_trees: int = 200,
                 max_depth: int = 30) -> DataFrame:
    """F10 re-aimed: a stored forest on stored float-array vectors (array_to_vector, no Python)."""
    e = fx.embeddings(spark, sf_dir)
    d = e.withColumn("is_train", keyed.uniform("vec_id", seed=SEED) < F.lit(0.8))
    train = materialize(d.filter("is_train").select("vec_id", "embedding", "label"), require="training vectors")

    def vectors(df):
        return df.withColumn("features", array_to_vector("embedding")).drop("embedding")

    found = ModelStore(spark).get_or_fit(
        "vector-target-forests", {"num_trees": num_trees, "max_depth": max_depth, "seed": SEED, "layout": 2}, train,
        lambda: TargetForests.fit(vectors(train), ["label"], num_trees, max_depth).bundle())
    pred = TargetForests.of(found, ["label"]).predict(vectors(d.filter(~F.col("is_train"))).select("vec_id", "features", "label"))
    return pred.select("vec_id", F.col("label").cast("int").alias("label"), F.col("pred_label").cast("int").alias("predicted"))


def fit_text_vectors(train: DataFrame, size: int = 100, min_count: int = 5, rows_per_part: int = 100_000) -> PipelineModel:
    """F10 from text: word embeddings trained on the cleaned training texts; a text's vector is the mean of its
    words' (zeros where it has none that occur ``min_count`` times).  Word vectors are averaged over the
    partitions after each pass, so their number follows the rows: one per ``rows_per_part``.  The model
    holds one vector per word of the vocabulary; raise ``min_count`` to bound it."""
    parts = max(1, -(-train.count() // rows_per_part))
    return Pipeline(stages=[
        TicketCleaner(inputCol="input_teks", outputCol="clean_teks"),
        RegexTokenizer(inputCol="clean_teks", outputCol="words", pattern=r"\S+", gaps=False, toLowercase=False),
        Word2Vec(inputCol="words", outputCol="features", vectorSize=size, minCount=min_count, seed=SEED,
                 numPartitions=parts)]).fit(train)


def text_vector_split(spark: SparkSession, source, size: int = 100):
    """(vectors of the training tickets, of the test tickets) as written tables with id and targets, from the
    stored embeddings of the source's training tickets."""
    s = tk.with_targets(tk.with_input(tk.ticket_rows(spark, source)))
    s = s.withColumn("is_train", keyed.uniform("ticket_id", seed=SEED) < F.lit(0.8))
    s = materialize(s.select("ticket_id", "input_teks", *tk.TARGETS, "is_train"), require="tickets of the text vectors")
    train = s.filter("is_train").select("ticket_id", "input_teks", *tk.TARGETS)
    found = ModelStore(spark).get_or_fit("text-vectors", {"size": size, "seed": SEED}, train,
                                         lambda: Bundle({"vectors": fit_text_vectors(train, size)}))
    rows = materialize(found.models["vectors"].transform(s).select("ticket_id", "features", *tk.TARGETS, "is_train"))
    return rows.filter("is_train").drop("is_train"), rows.filter("not is_train").drop("is_train")


def _target_forests(spark: SparkSession, train: DataFrame, num_trees: int, max_depth: int) -> TargetForests:
    """The stored forests of every target on one vector column."""
    params = {"num_trees": num_trees, "max_depth": max_depth, "seed": SEED, "layout": 2}
    found = ModelStore(spark).get_or_fit("text-vector-forests", params, train, lambda: TargetForests.fit(
        train, tk.TARGETS, num_trees, max_depth, len(tk.TARGETS), GRID_TREE_OPTS).bundle())
    return TargetForests.of(found, tk.TARGETS)


def _predict_targets(fitted: TargetForests, rows: DataFrame) -> DataFrame:
    return fitted.predict(rows).select("ticket_id", *tk.TARGETS, *[f"pred_{t}" for t in tk.TARGETS])


def text_vector_model(spark: SparkSession, source, num_trees: int = 200, max_depth: int = 10) -> DataFrame:
    """F10 + E6/E7: four forests on text vectors; a row per test ticket with its four predictions, beside them
    the exact match and each target's accuracy over all test tickets."""
    train, test = text_vector_split(spark, source)
    pred = materialize(_predict_targets(_target_forests(spark, train, num_trees, max_depth), test))
    report = exact_match_report(pred, [(t, f"pred_{t}") for t in tk.TARGETS])  # one row
    return pred.join(F.broadcast(report.withColumnRenamed("n", "n_test")))


def text_vector_grid(spark: SparkSession, source, tree_counts=(100, 200), depths=(30, 10), folds: int = 3) -> DataFrame:
    """M4 over text vectors: exact match of every (trees, depth) over keyed folds of the training tickets; the
    best setting (then the smaller) is fitted again to all of them and scored on the test tickets.  The
    vectors are written once and shared by all settings; depth 30 stands for unlimited."""
    train, test = text_vector_split(spark, source)
    fold = F.floor(keyed.uniform("ticket_id", F.lit("fold"), seed=SEED) * folds).cast("int")
    settings = [(n, d) for n in tree_counts for d in depths]
    scored = [grid_scores(materialize(train.filter(fold != f)), train.filter(fold == f), settings) for f in range(folds)]
    scores = [(n, d, f, x) for f, xs in enumerate(scored) for (n, d), x in zip(settings, xs)]
    mean = {(n, d): sum(x for a, b, _, x in scores if (a, b) == (n, d)) / folds for n in tree_counts for d in depths}
    best = min(mean, key=lambda k: (-mean[k], *k))
    pairs = [(t, f"pred_{t}") for t in tk.TARGETS]
    final = exact_match_report(_predict_targets(_target_forests(spark, train, *best), test), pairs).first()
    rows = [(n, d, x, (n, d) == best, float(final["exact_match"] or 0.0) if (n, d) == best else None)
            for (n, d), x in sorted(mean.items())]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, mean_exact_match double, best boolean, "
                                       "test_exact_match double")
