"""Descriptive tables behind the reference's charts (A8-A12).  Quantiles are exact (``stats.exact_quantiles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.operators.stats import exact_quantiles


def _measures(df: DataFrame, keep: list[str], cols: list[str], name: str) -> DataFrame:
    """One row per row and measure: ``name`` and the value ``v`` (missing values left out)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("s")).select(*keep, f"s.{name}", "s.v").filter(F.col("v").isNotNull())


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles (linear interpolation), max per column; a column without
    values has a count of 0 and no other number."""
    long = _measures(df, [], cols, "column")
    stats = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                       F.min("v").alias("min"), F.max("v").alias("max"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    quartiles = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]).drop("n")
    out = every.join(stats, "column", "left").join(quartiles, "column", "left").withColumns(
        {"q25": F.col("q")[0], "q50": F.col("q")[1], "q75": F.col("q")[2]})
    return out.select("column", F.coalesce("count", F.lit(0).cast("long")).alias("count"),
                      *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def boxplot_stats(df: DataFrame, group: str, measures: list[str], digits: int = 6) -> DataFrame:
    """Per group and measure the quartiles, whiskers (most extreme datum within 1.5 IQR
    of the box) and the number of points beyond them; whiskers from one more aggregate
    against the quartiles (a group-sized table joined back)."""
    long = _measures(df.filter(F.col(group).isNotNull()), [group], measures, "measure")
    qs = exact_quantiles(long, [group, "measure"], "v", [0.25, 0.5, 0.75])
    qs = qs.select(F.col(group).alias("_g"), F.col("measure").alias("_m"), F.col("q")[0].alias("q1"),
                   F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - iqr * 1.5, F.col("q3") + iqr * 1.5
    j = long.join(qs, (long[group] == qs["_g"]) & (long["measure"] == qs["_m"]))
    out = j.groupBy(group, "measure", "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_hi"),
        F.count(F.when((F.col("v") < lo) | (F.col("v") > hi), 1)).alias("n_outliers"))
    return out.select(group, "measure", *[F.round(c, digits).alias(c) for c in
                                          ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                      "n_outliers")


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """How often each pair of values occurs, one row per pair (missing on either side
    excluded).  All values count; ``pivot_counts`` spreads them over columns."""
    return (df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
            .groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n")))


def pivot_counts(pairs: DataFrame, rows: str, cols: str) -> DataFrame:
    """The pairs of ``crosstab`` as one column per value found, zero where a pair does not occur."""
    values = sorted(r[0] for r in pairs.select(cols).distinct().collect())  # columns to be
    return pairs.groupBy(rows).pivot(cols, values).agg(F.sum("n")).fillna(0, subset=values)


def table_profile(df: DataFrame) -> DataFrame:
    """Per column its type, non-null count and the row count (one aggregate)."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(f"`{c}`")).alias(f"n__{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("column"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                              F.col(f"n__{i}").alias("non_null"),
                              F.col("__rows").alias("n_rows"))
                     for i, c in enumerate(df.columns)])
    return wide.select(F.explode(rows).alias("s")).select("s.*")
