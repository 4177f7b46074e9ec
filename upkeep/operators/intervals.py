"""Maintenance-interval lists per asset type (A3, A4, O4) and the urgency pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.operators.rollup import CRITICALITY_DEFAULT, CRITICALITY_WEIGHT, value_map
from upkeep.sources.fixtures import INTERVALS

TYPE_KEYS = ["kategori", "sub_kategori", "tipe"]
UNKNOWN_RANK = 99
INTERVAL_RANK = {name: i + 1 for i, name in enumerate(INTERVALS)}


def interval_rank(c) -> Column:
    return value_map(c, INTERVAL_RANK, UNKNOWN_RANK)


def interval_lists(schedule: DataFrame) -> DataFrame:
    """Per type the distinct allowed intervals, tightest first (unknown names rank 99 and
    keep their first-seen order; a missing interval stays in the list).

    A4 distinct keeps each pair's first ``row_seq``; A3 collects one small list per type
    (bounded by the number of distinct interval names).  ``collect_list`` of a struct keeps
    null values, ``collect_list`` of the bare column would drop them.
    """
    firsts = (schedule.filter(F.col("kategori").isNotNull() & F.col("sub_kategori").isNotNull()
                              & F.col("tipe").isNotNull())
              .groupBy(*TYPE_KEYS, "frekuensi").agg(F.min("row_seq").alias("first_seq")))
    entries = F.array_sort(F.collect_list(
        F.struct(interval_rank("frekuensi").alias("rank"), F.col("first_seq"),
                 F.col("frekuensi"))))
    return (firsts.groupBy(*TYPE_KEYS).agg(entries.alias("_e"))
            .select(*TYPE_KEYS, F.transform("_e", lambda e: e["frekuensi"]).alias("intervals")))


def urgency(n, mean_sev, criticality, age_years) -> Column:
    """0.30*min(n/10,1) + 0.30*sev/4 + 0.20*criticality + 0.20*min(age/10,1), added in this
    order (the pick truncates, so the last bit matters)."""
    a = F.least(F.col(n) / F.lit(10.0), F.lit(1.0)) * F.lit(0.30)
    b = (F.col(mean_sev) / F.lit(4.0)) * F.lit(0.30)
    c = value_map(criticality, CRITICALITY_WEIGHT, CRITICALITY_DEFAULT) * F.lit(0.20)
    d = F.least(F.col(age_years) / F.lit(10.0), F.lit(1.0)) * F.lit(0.20)
    return ((a + b) + c) + d


def urgency_without_age(n, mean_sev, criticality) -> Column:
    """The score with the age factor left out (a fixed alternative predictor)."""
    a = F.least(F.col(n) / F.lit(10.0), F.lit(1.0)) * F.lit(0.30)
    b = (F.col(mean_sev) / F.lit(4.0)) * F.lit(0.30)
    c = value_map(criticality, CRITICALITY_WEIGHT, CRITICALITY_DEFAULT) * F.lit(0.20)
    return (a + b) + c


def pick_interval(intervals, u) -> Column:
    """idx = clamp(trunc((1-u)(k-1)), 0, k-1); no list -> null; one entry -> that one."""
    arr = F.col(intervals) if isinstance(intervals, str) else intervals
    u = F.col(u) if isinstance(u, str) else u
    k = F.size(arr)
    idx = ((F.lit(1.0) - u) * (k - 1)).cast("int")
    idx = F.least(F.greatest(idx, F.lit(0)), k - 1)
    return (F.when(arr.isNull() | (k == 0), F.lit(None).cast("string"))
             .when(k == 1, F.element_at(arr, 1))
             .otherwise(F.element_at(arr, idx + 1)))
