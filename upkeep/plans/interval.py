"""Interval labelling: which maintenance interval does each asset get (TR/EDA pipeline)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions.dates import age_years, parse_date
from upkeep.operators import intervals as iv
from upkeep.operators.ordering import null_safe_on
from upkeep.operators.rollup import attach_counts, complaint_counts
from upkeep.sources import fixtures as fx

#: Severity words of the fixture complaints with the classifier's default for others.  The
#: reference's own words are the preset ``"interval"``.
GRADED = ({"Ringan": 1, "Sedang": 2, "Berat": 3, "Fatal": 4}, 2)
AS_OF = "2002-01-01"  # replaces the wall clock of the reference, so results are repeatable


def asset_conditions(spark: SparkSession, sf_dir: str, as_of: str = AS_OF,
                     severity=GRADED) -> DataFrame:
    """Assets with complaint count, mean severity and age.  ``severity`` is the severity
    vocabulary: a (mapping, default), or ``"interval"``, the reference's words (default 2)."""
    a = fx.assets(spark, sf_dir)
    base = attach_counts(a, complaint_counts(fx.complaints(spark, sf_dir), severity))
    return base.withColumn("umur_aset_tahun",
                           age_years(as_of, parse_date("tanggal_instalasi")))


def scored_assets(spark: SparkSession, sf_dir: str, as_of: str = AS_OF,
                  severity=GRADED) -> DataFrame:
    """Assets with their type's interval list and urgency score."""
    base = asset_conditions(spark, sf_dir, as_of, severity)
    lists = iv.interval_lists(fx.schedule(spark, sf_dir))
    j = base.join(lists, iv.TYPE_KEYS, "left")  # J7: a dict probe; null keys never match
    u = iv.urgency("jumlah_komplain", "rata_severity", "tingkat_kekritisan", "umur_aset_tahun")
    return j.withColumn("urgency", u)


def interval_assignment(spark: SparkSession, sf_dir: str, as_of: str = AS_OF,
                        severity=GRADED) -> DataFrame:
    """Flagship: one interval label per asset (null when its type has no schedule)."""
    return (scored_assets(spark, sf_dir, as_of, severity)
            .select("id", "kategori", "sub_kategori", "tipe", "tingkat_kekritisan",
                    "jumlah_komplain", "rata_severity", "umur_aset_tahun", "urgency",
                    F.when(F.col("intervals").isNull(), F.lit(0)).otherwise(F.size("intervals"))
                    .cast("long").alias("n_intervals"),
                    iv.pick_interval("intervals", "urgency").alias("frekuensi")))


def labelled_assets(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Training set of the interval classifier: assets whose label is not missing."""
    return interval_assignment(spark, sf_dir, as_of).filter(F.col("frekuensi").isNotNull())


def interval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the label (missing labels excluded)."""
    return (labelled_assets(spark, sf_dir).groupBy("frekuensi")
            .agg(F.count(F.lit(1)).alias("n_assets")))


def asset_complaint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + J1 + J11 + P10: every asset with its complaint count and mean severity."""
    base = attach_counts(fx.assets(spark, sf_dir),
                         complaint_counts(fx.complaints(spark, sf_dir), GRADED))
    return base.select("id", "kategori", "tingkat_kekritisan", "jumlah_komplain", "rata_severity")


def schedule_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + P7: every asset with every allowed interval of its type (the old labelling,
    many-to-many on purpose; fan-out bounded by the intervals per type)."""
    a = asset_conditions(spark, sf_dir)
    s = fx.schedule(spark, sf_dir)
    j = a.join(s, null_safe_on(a, s, iv.TYPE_KEYS), "inner").dropna(how="any",
                                                                   subset=["frekuensi"])
    return j.select(a["id"], a["kategori"], a["sub_kategori"], a["tipe"],
                    a["tingkat_kekritisan"], a["jumlah_komplain"], a["rata_severity"],
                    s["frekuensi"], s["row_seq"].alias("schedule_seq"))


def schedule_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First schedule row per type (keep-first in file order)."""
    from upkeep.operators.ordering import first_per_key
    s = fx.schedule(spark, sf_dir)
    return first_per_key(s, iv.TYPE_KEYS, "row_seq").select(*iv.TYPE_KEYS, "frekuensi")


def interval_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + O4: allowed intervals per type, tightest first."""
    lists = iv.interval_lists(fx.schedule(spark, sf_dir))
    return lists.select(*iv.TYPE_KEYS, F.size("intervals").cast("long").alias("n_intervals"),
                        F.array_join("intervals", ",").alias("intervals"))


def profile_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptive script's table: assets with complaint rollup fanned out to every
    allowed interval of their type."""
    return schedule_fanout(spark, sf_dir)


def severity_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upkeep.operators.profile import describe
    return describe(profile_base(spark, sf_dir), ["jumlah_komplain", "rata_severity"])


def complaint_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upkeep.operators.profile import boxplot_stats
    return boxplot_stats(profile_base(spark, sf_dir), "frekuensi",
                         ["jumlah_komplain", "rata_severity"])


def criticality_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upkeep.operators.profile import crosstab
    return crosstab(profile_base(spark, sf_dir), "tingkat_kekritisan", "frekuensi")


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upkeep.operators.profile import table_profile as prof
    return prof(fx.assets(spark, sf_dir))


LABEL_CAT_COLS = ["kategori", "sub_kategori", "tipe", "tingkat_kekritisan"]


def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + F1: sorted-distinct codes of the four categorical features (missing ->
    'Unknown') and of the label, fitted on the labelled assets."""
    from upkeep.operators.encoding import apply_label_codes, fit_label_codes
    lab = labelled_assets(spark, sf_dir)
    codes = fit_label_codes(lab, LABEL_CAT_COLS + ["frekuensi"])
    out = apply_label_codes(lab, codes, LABEL_CAT_COLS + ["frekuensi"])
    return out.select("id", *[f"{c}_code" for c in LABEL_CAT_COLS + ["frekuensi"]])


def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 80/20 split of the labelled assets by label."""
    from upkeep.operators.splits import stratified_split
    return stratified_split(labelled_assets(spark, sf_dir), "frekuensi", "id")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_split(spark, sf_dir).select("id", "frekuensi", "is_train")


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 on the test part, for a fixed predictor: the pick with the age factor left out.  Assets are scored
    once; both picks go through the split."""
    from upkeep.operators.evaluate import classification_report as report
    from upkeep.operators.splits import stratified_split as split
    u0 = iv.urgency_without_age("jumlah_komplain", "rata_severity", "tingkat_kekritisan")
    both = scored_assets(spark, sf_dir).select("id", iv.pick_interval("intervals", "urgency").alias("frekuensi"),
                                               iv.pick_interval("intervals", u0).alias("predicted"))
    test = split(both.filter(F.col("frekuensi").isNotNull()), "frekuensi", "id").filter(~F.col("is_train"))
    return report(test, "frekuensi", "predicted")
