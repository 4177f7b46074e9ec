"""Per-asset rollups (A1, A2) and value-map lookups.

Every rollup is one ``groupBy().agg()``: Spark aggregates partially inside each task before
the shuffle, so a key holding a third of all rows sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (reference presets) ------------------------------------------------
# Severity vocabulary of the interval classifier and the descriptive script; default 2.
SEVERITY_MAP_INTERVAL = {"Rendah": 1, "Sedang": 2, "Tinggi": 3, "Kritis": 4,
                         "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
SEVERITY_DEFAULT_INTERVAL = 2
# Severity vocabulary of the lifespan notebooks; default 1.
SEVERITY_MAP_LIFESPAN = {"Ringan": 1, "Sedang": 2, "Berat": 3, "Fatal": 4}
SEVERITY_DEFAULT_LIFESPAN = 1
# Criticality weight in the urgency score; default 0.3.
CRITICALITY_WEIGHT = {"Critical": 1.0, "Major": 0.6, "Minor": 0.2}
CRITICALITY_DEFAULT = 0.3
# ---------------------------------------------------------------------------------------

SEVERITY_PRESETS = {
    "interval": (SEVERITY_MAP_INTERVAL, SEVERITY_DEFAULT_INTERVAL),
    "lifespan": (SEVERITY_MAP_LIFESPAN, SEVERITY_DEFAULT_LIFESPAN),
}


def value_map(c, mapping: dict, default) -> Column:
    """``s.map(mapping).fillna(default)`` as a constant map (folded by Catalyst)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(m[c], F.lit(default))


def severity_num(c, preset) -> Column:
    """``preset``: a preset name ('interval', 'lifespan') or a (mapping, default) pair."""
    mapping, default = SEVERITY_PRESETS[preset] if isinstance(preset, str) else preset
    return value_map(c, mapping, default)


def complaint_counts(complaints: DataFrame, preset="interval") -> DataFrame:
    """A1: per asset, number of complaints and mean severity (null asset ids dropped, as
    pandas ``groupby`` does)."""
    return (complaints.filter(F.col("id").isNotNull())
            .groupBy("id")
            .agg(F.count("id").alias("jumlah_komplain"),
                 F.avg(severity_num("severity", preset)).alias("rata_severity")))


def attach_counts(assets: DataFrame, counts: DataFrame) -> DataFrame:
    """J1 + P10: assets left-joined to the rollup, missing counts filled with 0."""
    return (assets.join(counts, "id", "left")
            .fillna({"jumlah_komplain": 0, "rata_severity": 0.0}))


def asset_rollup(dated_complaints: DataFrame, date_col: str = "tanggal",
                 preset: str = "lifespan") -> DataFrame:
    """A2 (+W1 folded in): per asset count, mean/max severity, cost sum/mean, mean gap.

    The mean of consecutive day gaps telescopes to (last - first) / (n - 1), so the
    per-asset history needs no sort and no window: one partial+final aggregate.  pandas
    sums an all-missing group to 0 (Spark: null), hence the coalesce.
    """
    d = F.col(date_col)
    n = F.count(d)
    return (dated_complaints.filter(F.col("id").isNotNull())
            .withColumn("_sev", severity_num("severity", preset))
            .groupBy("id")
            .agg(n.alias("total_komplain"),
                 F.avg("_sev").alias("severity_mean"),
                 F.max("_sev").alias("severity_max"),
                 F.coalesce(F.sum("biaya_perbaikan"), F.lit(0.0)).alias("biaya_total"),
                 F.avg("biaya_perbaikan").alias("biaya_mean"),
                 F.try_divide(F.datediff(F.max(d), F.min(d)).cast("double"),
                              (n - 1).cast("double")).alias("hari_antar_komplain_mean")))
