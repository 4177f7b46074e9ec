"""Categorical encoders as DataFrame operations (F1 label codes, F2 smoothed target mean).

Both fit with ONE aggregate over ``explode(array(struct(column, value)))`` - one scan for
all columns instead of one per column - and apply with one left join per column to a
table whose size is the number of categories (Spark broadcasts it at runtime when AQE
measures it small; no hint on data-derived tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _long_form(df: DataFrame, cols: list[str], keep: list[str], missing: str | None
               ) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               (F.coalesce(F.col(c).cast("string"), F.lit(missing))
                                if missing is not None else F.col(c).cast("string"))
                               .alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.column", "_p.value")


# ---- F1 ---------------------------------------------------------------------------------

def fit_label_codes(df: DataFrame, cols: list[str], missing: str = "Unknown") -> DataFrame:
    """LabelEncoder: per column the sorted distinct values get codes 0..n-1 (missing values
    are first replaced by ``missing``).  Result: (column, value, code), materialised (a
    fitted encoder with one row per category)."""
    from upkeep.session import materialize
    distinct = _long_form(df, cols, [], missing).distinct()
    from upkeep.operators.ordering import row_number_within
    numbered = row_number_within(distinct, ["column"], ["value"], rn_col="code")
    return materialize(numbered.withColumn("code", (F.col("code") - 1).cast("long")))


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: list[str],
                      missing_text: str = "Unknown", unknown_code: int | None = None,
                      suffix: str = "_code") -> DataFrame:
    """Replace each column by its code.  ``missing_text`` is what a missing value reads as
    (training: 'Unknown'; the scoring script reads it as 'nan').  A value never seen in
    training gets ``unknown_code`` (the scoring script uses 0); None keeps it null."""
    out = df
    for c in cols:
        m = codes.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        key = F.coalesce(F.col(c).cast("string"), F.lit(missing_text))
        out = out.join(m, key == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        if unknown_code is not None:
            out = out.withColumn(f"{c}{suffix}",
                                 F.coalesce(F.col(f"{c}{suffix}"), F.lit(unknown_code)))
    return out


# ---- F2 ---------------------------------------------------------------------------------

def fit_target_encoding(train: DataFrame, cols: list[str], target: str,
                        smoothing: float = 10.0, min_samples_leaf: int = 20) -> DataFrame:
    """Smoothed target mean per category (library default blend):

        w   = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))
        enc = prior * (1 - w) + mean * w          (a category seen once gets the prior)

    prior = mean target of the training rows.  A missing value is its own category.
    Result: (column, value, n, mean, enc) plus one row per column with value null and
    ``is_prior`` for unseen categories.
    """
    from upkeep.session import materialize
    # the prior is one number: computed once and passed as a literal
    prior = F.lit(train.select(F.avg(target).cast("double")).first()[0]).cast("double")
    long = _long_form(train.filter(F.col(target).isNotNull()), cols, [target], None)
    stats = long.groupBy("column", "value").agg(F.count(target).alias("n"),
                                                F.avg(target).alias("mean"))
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(min_samples_leaf))
                                         / F.lit(float(smoothing))))
    enc = F.when(F.col("n") == 1, prior).otherwise(prior * (F.lit(1.0) - w) + F.col("mean") * w)
    # the fitted encoder (one row per category) is cut from its lineage: every column's
    # join reads it instead of recomputing the training aggregate
    return materialize(stats.withColumns({"enc": enc, "prior": prior}))


def apply_target_encoding(df: DataFrame, enc: DataFrame, cols: list[str],
                          prefix: str = "te_") -> DataFrame:
    """Encode each column; a category unseen in training (including a missing value when
    training had none) gets the prior."""
    out = df
    for c in cols:
        m = enc.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("enc").alias(f"{prefix}{c}"),
            F.col("prior").alias(f"_prior_{c}"))
        out = (out.join(m, F.col(c).cast("string").eqNullSafe(F.col(f"_v_{c}")), "left")
               .drop(f"_v_{c}", f"_prior_{c}"))
    prior_row = enc.select(F.first("prior")).first()
    prior = F.lit(prior_row[0] if prior_row else None).cast("double")
    return out.withColumns(
        {f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}"), prior) for c in cols})
