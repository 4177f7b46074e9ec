"""Remaining-life and lifespan pipelines (complaint level and asset level).

Complaint level: dated complaints -> asset attributes (left) -> first usable replacement
(inner: only replaced assets) -> first schedule row of the type (left) -> RUL target ->
history features -> time split -> target encoding -> critical oversampling.
Asset level: replacement-labelled assets -> type schedule -> complaint rollup -> median
imputation -> formula target -> time split -> encodings -> fixed-predictor reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import keyed
from upkeep.functions.dates import parse_date
from upkeep.operators.encoding import apply_target_encoding, fit_target_encoding
from upkeep.operators.history import history_features
from upkeep.operators.intervals import TYPE_KEYS
from upkeep.operators.ordering import first_per_key
from upkeep.operators.rollup import asset_rollup, severity_num
from upkeep.operators.splits import time_split
from upkeep.operators.stats import quantile_scalar
from upkeep.session import materialize
from upkeep.sources import fixtures as fx

SEED = 42
CAT_COLS = ["kategori", "sub_kategori", "tipe", "merek", "tingkat_kekritisan", "frekuensi"]


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def dated_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints with parsed dates; rows without a work date are dropped."""
    c = fx.complaints(spark, sf_dir)
    return (c.withColumn("tanggal", parse_date("tanggal_pengerjaan"))
            .dropna(how="any", subset=["tanggal"]))


def first_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement date per asset: missing dates dropped, then keep-first per asset."""
    r = (fx.replacements(spark, sf_dir)
         .withColumn("tanggal_penggantian", parse_date("tanggal_penggantian"))
         .dropna(how="any", subset=["tanggal_penggantian"]))
    return first_per_key(r, ["id"], "row_seq").select("id", "tanggal_penggantian")


def type_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.schedule(spark, sf_dir)
    return first_per_key(s, TYPE_KEYS, "row_seq").select(*TYPE_KEYS, "frekuensi")


def _with_schedule(df: DataFrame, sched: DataFrame) -> DataFrame:
    """Left join on the (nullable) type keys, matching missing with missing."""
    s = sched.select(*[F.col(k).alias(f"_s_{k}") for k in TYPE_KEYS], "frekuensi")
    cond = None
    for k in TYPE_KEYS:
        c = df[k].eqNullSafe(s[f"_s_{k}"])
        cond = c if cond is None else cond & c
    return df.join(s, cond, "left").drop(*[f"_s_{k}" for k in TYPE_KEYS])


def complaint_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + J4 + J5: complaints of replaced assets with asset attributes and schedule."""
    a = fx.assets(spark, sf_dir).select(
        "id", parse_date("tanggal_instalasi").alias("tanggal_instalasi"), "merek",
        "tingkat_kekritisan")
    m = dated_complaints(spark, sf_dir).join(a, "id", "left")
    m = m.join(first_replacements(spark, sf_dir), "id", "inner")
    return _with_schedule(m, type_schedule(spark, sf_dir))


def rul_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + P5: real remaining life = replacement - work date in days, kept when >= 0."""
    b = complaint_base(spark, sf_dir)
    return (b.withColumn("target_rul",
                         F.datediff("tanggal_penggantian", "tanggal").cast("long"))
            .filter(F.col("target_rul") >= 0))


def rul_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rul_rows(spark, sf_dir)
    return r.select("id", "row_seq", iso("tanggal").alias("tanggal"),
                    iso("tanggal_penggantian").alias("tanggal_penggantian"), "target_rul")


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complaint-level features over the RUL rows (one chunked window pass)."""
    r = rul_rows(spark, sf_dir).withColumn("severity_num",
                                           severity_num("severity", "lifespan").cast("long"))
    h = history_features(r, key="id", date="tanggal", seq="row_seq", sev="severity_num")
    umur = F.datediff("tanggal", "tanggal_instalasi").cast("long")
    return h.select(
        "id", "row_seq", "tanggal", "target_rul",
        umur.alias("umur_saat_komplain"),
        F.col("running_number").alias("total_komplain_historis"),
        F.coalesce(F.col("gap_days").cast("long"), umur).alias("jarak_servis_sebelumnya"),
        "severity_num",
        F.col("max_sev_3").alias("max_severity_3"),
        "biaya_perbaikan",
        F.try_divide(F.col("biaya_perbaikan"), (umur + 1).cast("double")).alias("cost_density"),
        "kategori", "sub_kategori", "tipe", "merek", "tingkat_kekritisan", "frekuensi")


def complaint_history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_rows(spark, sf_dir).withColumn("tanggal", iso("tanggal"))


def penalty_columns(df: DataFrame, noise_scale: float = 10.0, seed: int = SEED) -> DataFrame:
    """C28 (complaint level): 2000 - age - 150*severity - 40*n, floored at a keyed draw in
    1..13, plus keyed N(0, noise_scale), absolute value."""
    base = (F.lit(2000) - F.col("umur_saat_komplain") - F.col("severity_num") * 150
            - F.col("total_komplain_historis") * 40).cast("double")
    floor_draw = keyed.randint(1, 14, "id", "row_seq", seed=seed)
    floored = F.greatest(floor_draw.cast("double"), base)
    z = keyed.gaussian("id", "row_seq", seed=seed)
    return df.withColumns({
        "base_rul": base, "floor_draw": floor_draw,
        "target_noise0": F.abs(floored),
        "target_keyed": F.round(F.abs(floored + F.lit(float(noise_scale)) * z), 6)})


def penalty_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = penalty_columns(history_rows(spark, sf_dir))
    return h.select("id", "row_seq", "base_rul", "floor_draw", "target_noise0", "target_keyed")


def complaint_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global time-ordered 80/20 split of the complaint features (ties by id, seq)."""
    h = materialize(history_rows(spark, sf_dir))  # read by the boundary and, mostly more than once, by consumers
    return time_split(h, ["tanggal", "id", "row_seq"])


def time_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split alone needs no features, and writes nothing."""
    s = time_split(rul_rows(spark, sf_dir), ["tanggal", "id", "row_seq"])
    return s.select("id", "row_seq", iso("tanggal").alias("tanggal"), "is_train")


def critical_oversample(spark: SparkSession, sf_dir: str, threshold: int = 60,
                        copies: int = 2, jitter: float = 0.03, seed: int = SEED
                        ) -> DataFrame:
    """F8 + A14 + U1: training rows with RUL <= threshold get ``copies`` extra copies with
    3% Gaussian jitter on three columns (noise std measured on the copied rows, as the
    reference does), absolute values; union with the training rows.  One pass: each
    critical row explodes into its copies."""
    train = complaint_time_split(spark, sf_dir).filter("is_train")
    cols = ["umur_saat_komplain", "jarak_servis_sebelumnya", "cost_density"]
    out = oversample(train, threshold, copies, jitter, seed)
    return out.select("id", "row_seq", "copy", "target_rul",
                      *[F.round(c, 6).alias(c) for c in cols])


COMPLAINT_NUMERIC = ["umur_saat_komplain", "total_komplain_historis", "jarak_servis_sebelumnya",
                     "severity_num", "max_severity_3", "biaya_log", "cost_density"]


def complaint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complaint features with the cost on a log scale and the real remaining life as target,
    split by time."""
    s = complaint_time_split(spark, sf_dir)
    return s.withColumns({"biaya_log": F.log1p("biaya_perbaikan"),
                          "target": F.col("target_rul").cast("double")})


def complaint_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + F7 on complaints: encodings fitted on the training part, applied to every row."""
    s = complaint_split(spark, sf_dir)  # a comparison per row of the written features
    enc = fit_target_encoding(s.filter("is_train"), CAT_COLS, "target")
    out = apply_target_encoding(s, enc, CAT_COLS)
    return out.select("id", "row_seq", "is_train", F.round("biaya_log", 6).alias("biaya_log"),
                      *[F.round(f"te_{c}", 6).alias(f"te_{c}") for c in CAT_COLS])


def oversample(train: DataFrame, threshold: int = 60, copies: int = 2, jitter: float = 0.03,
               seed: int = SEED) -> DataFrame:
    """F8: the training rows and ``copies`` of each with a remaining life of ``threshold`` days at most,
    three columns jittered by keyed Gaussian noise of ``jitter`` of their deviation."""
    cols = ["umur_saat_komplain", "jarak_servis_sebelumnya", "cost_density"]
    copied = train.filter(F.col("target_rul") <= threshold).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    stds = copied.agg(F.struct(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols])
                      .alias("s")).scalar()
    jittered = copied.withColumns({
        c: F.abs(F.col(c).cast("double") + stds[c] * F.lit(jitter)
                 * keyed.gaussian("id", "row_seq", "copy", F.lit(c), seed=seed)) for c in cols})
    orig = train.withColumn("copy", F.lit(0)).withColumns({c: F.col(c).cast("double") for c in cols})
    return orig.unionByName(jittered.select(*orig.columns))


# ---- asset level (MP2) --------------------------------------------------------------------

def labelled_assets(spark: SparkSession, sf_dir: str, fit_on: str = "train") -> DataFrame:
    """Replaced assets with type schedule and complaint rollup; zero fills; the mean gap
    imputed with the exact median, fitted on the training part of the time split, or on all rows
    (``fit_on='all'``, as the reference does before its split: test rows leak into it)."""
    a = fx.assets(spark, sf_dir).select(
        "id", parse_date("tanggal_instalasi").alias("tanggal_instalasi"), *TYPE_KEYS,
        "merek", "tingkat_kekritisan")
    lab = first_replacements(spark, sf_dir).join(a, "id", "inner")
    lab = _with_schedule(lab, type_schedule(spark, sf_dir))
    roll = asset_rollup(dated_complaints(spark, sf_dir), "tanggal", "lifespan")
    lab = lab.join(roll, "id", "left").fillna(
        0, subset=["total_komplain", "severity_max"]).fillna(
        0.0, subset=["severity_mean", "biaya_total", "biaya_mean"])
    # the asset feature table feeds the median, the split and every consumer after it
    lab = materialize(lab)
    if fit_on == "all":
        fit_rows = lab
    elif fit_on == "train":
        fit_rows = time_split(lab, ["tanggal_penggantian", "id"]).filter("is_train")
    else:
        raise ValueError(fit_on)
    med = quantile_scalar(fit_rows, "hari_antar_komplain_mean", 0.5)
    return lab.withColumns({
        "hari_antar_komplain_mean": F.coalesce(F.col("hari_antar_komplain_mean"), med),
        "biaya_total_log": F.log1p("biaya_total"),
        "biaya_mean_log": F.log1p("biaya_mean")})


def lifespan_columns(df: DataFrame, noise_scale: float = 30.0, seed: int = SEED) -> DataFrame:
    """C28 (asset level): 3000 - 80*n - 250*max severity - 20*log1p(cost) + keyed noise."""
    base = (F.lit(3000.0) - F.col("total_komplain") * 80 - F.col("severity_max") * 250
            - F.log1p("biaya_total") * 20)
    z = keyed.gaussian("id", seed=seed)
    return df.withColumns({"target_noise0": F.abs(base),
                           "target_keyed": F.abs(base + F.lit(float(noise_scale)) * z)})


def asset_rollup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled_assets(spark, sf_dir)
    r6 = lambda c: F.round(c, 6).alias(c)  # noqa: E731  (sums of money: order-free digits)
    return lab.select("id", iso("tanggal_penggantian").alias("tanggal_penggantian"),
                      *TYPE_KEYS, "merek", "tingkat_kekritisan", "frekuensi",
                      "total_komplain", r6("severity_mean"), "severity_max", r6("biaya_total"),
                      r6("biaya_mean"), r6("hari_antar_komplain_mean"), r6("biaya_total_log"),
                      r6("biaya_mean_log"))


def lifespan_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lifespan_columns(labelled_assets(spark, sf_dir))
    return t.select("id", F.round("target_noise0", 6).alias("target_noise0"),
                    F.round("target_keyed", 6).alias("target_keyed"))


def asset_split(spark: SparkSession, sf_dir: str, noise_scale: float = 0.0) -> DataFrame:
    """Labelled assets with the formula target, split 80/20 by replacement date."""
    t = lifespan_columns(labelled_assets(spark, sf_dir), noise_scale=noise_scale)
    t = t.withColumn("target", F.col("target_keyed"))
    # fitting, encoding and reports all read the split: materialise it once
    return materialize(time_split(t, ["tanggal_penggantian", "id"]))


def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 on the asset table: fit on the training part only, applied to every row."""
    s = asset_split(spark, sf_dir)
    enc = fit_target_encoding(s.filter("is_train"), CAT_COLS, "target")
    out = apply_target_encoding(s, enc, CAT_COLS)
    return out.select("id", "is_train", *[F.round(f"te_{c}", 6).alias(f"te_{c}")
                                          for c in CAT_COLS])


# ---- fixed-predictor reports --------------------------------------------------------------

def fixed_prediction(df: DataFrame) -> DataFrame:
    """A fixed linear predictor of lifespan (stands in for a fitted model so the report
    operators can be checked exactly): 2950 - 75*n - 240*max severity."""
    pred = F.lit(2950.0) - F.col("total_komplain") * 75 - F.col("severity_max") * 240
    return df.withColumns({"actual": F.bround("target", 0), "predicted": F.bround(pred, 0)})


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixed_prediction(asset_split(spark, sf_dir)).filter(~F.col("is_train"))
    return s.withColumn("error", F.abs(F.col("predicted") - F.col("actual")))


def worst_predictions(spark: SparkSession, sf_dir: str, k: int = 15, scored: DataFrame | None = None) -> DataFrame:
    """O3 + O5 + J14: the k largest errors with display attributes re-attached; of ``scored`` test rows (id,
    actual, predicted, error), by default the fixed predictor's."""
    p = (test_predictions(spark, sf_dir) if scored is None else scored).select("id", "actual", "predicted", "error")
    attrs = fx.assets(spark, sf_dir).select("id", *TYPE_KEYS, "merek")
    top = p.orderBy(F.desc("error"), F.asc("id")).limit(k)  # top-k is the feature
    return top.join(attrs, "id", "left")


def type_slice_error(spark: SparkSession, sf_dir: str, tipe: str = "gear", scored: DataFrame | None = None) -> DataFrame:
    """J8 + E9: test rows (of ``scored``, by default the fixed predictor's) whose asset is of one type (semi
    join) and their MAE."""
    ids = fx.assets(spark, sf_dir).filter(F.col("tipe") == tipe).select("id")
    p = (test_predictions(spark, sf_dir) if scored is None else scored).join(ids, "id", "left_semi")
    return p.agg(F.lit(tipe).alias("tipe"), F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("error"), 6).alias("mae"))


def diverse_sample(spark: SparkSession, sf_dir: str, n: int = 100, seed: int = SEED
                   ) -> DataFrame:
    """O7 + J12: one test row per type first (keep-first in test order), topped up at
    random (keyed hash order) from the remaining test rows to ``n``; when there are more
    types than ``n``, ``n`` of the first rows are drawn at random."""
    test = asset_split(spark, sf_dir).filter(~F.col("is_train")).select(
        "id", "tanggal_penggantian", *TYPE_KEYS)
    order = F.struct("tanggal_penggantian", "id")
    firsts = (test.groupBy(*TYPE_KEYS).agg(F.min_by("id", order).alias("id"))
              .withColumn("pick", F.lit("unique")))
    rest = (test.join(firsts.select("id"), "id", "left_anti")
            .select(*TYPE_KEYS, "id").withColumn("pick", F.lit("topup")))
    h = F.md5(F.concat_ws("|", F.col("id"), F.lit(str(seed))))
    both = firsts.unionByName(rest).withColumn("_h", h)
    # uniques first (all of them when they fit), then random top-up; bounded by n
    chosen = both.orderBy(F.col("pick") != "unique", "_h").limit(n)
    return chosen.select("id", *TYPE_KEYS, "pick")


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E5 on the fixed predictor's test rows: MAE, RMSE, R2, MedAE, MAPE, explained
    variance, max error."""
    from upkeep.operators.evaluate import regression_report
    p = test_predictions(spark, sf_dir)
    return regression_report(p, "actual", "predicted", key="id")
