"""Exact quantiles without sorting the data or collecting a value map into one task.

Spark's ``percentile`` keeps a value->count map per group and merges it in one task.  Here a sketch
(``percentile_approx``, bounded memory) gives every group a bracket around each quantile, wide enough for
the sketch's stated error; one more pass counts what lies below the bracket and, by value, what lies in
it; only the brackets' distinct values, a small fixed share of a group's rows, are put in order.  Interpolation
follows pandas/NumPy ``linear``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy of the sketch; brackets reach four times its error to both sides.
ACCURACY, REACH = 10_000, 4


def exact_quantiles(long: DataFrame, keys: list[str], value: str, qs: list[float], out: str = "q") -> DataFrame:
    """One row per group of ``keys`` (null a key of its own): ``n`` and the array ``out`` of the exact
    linear-interpolated quantiles ``qs`` of ``value``; null and NaN values are left out, groups without others too."""
    e = REACH / ACCURACY
    at = [min(1.0, max(0.0, x)) for q in qs for x in (q - e, q + e)]
    rows = long.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ks = [f"_k{i}" for i in range(len(keys))]
    sketch = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", at, ACCURACY).alias("_b"))
    named = sketch.select(*[F.col(k).alias(f"s{k}") for k in ks], "n", "_b").filter("n > 0")
    same = F.lit(True)
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
    joined = rows.join(named, same) if ks else rows.crossJoin(F.broadcast(named))  # without keys: one row
    # by bracket: the values inside one by one, what lies below and what lies above as one class each, whose
    # value next to the bracket may be needed too (in small groups)
    def place(i):
        lo, hi = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        side = F.when(F.col("_v") < lo, 0).when(F.col("_v") > hi, 2).otherwise(1)
        return F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 1, F.col("_v")).alias("v"))

    placed = joined.select(*ks, "n", "_v", F.explode(F.array(*[place(i) for i in range(len(qs))])).alias("p"))
    counts = placed.groupBy(*ks, "n", *[F.col(f"p.{c}").alias(c) for c in ("i", "side", "v")]).agg(
        F.count(F.lit(1)).alias("c"), F.max("_v").alias("top"), F.min("_v").alias("low"))
    upto = F.sum("c").over(Window.partitionBy(*ks, "i").orderBy("side", "v")
                           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = (F.col("n") - 1) * F.array(*[F.lit(float(q)) for q in qs])[F.col("i")]
    counts = counts.withColumns({"upto": upto, "h": h}).withColumn("first", F.col("upto") - F.col("c"))

    def at_position(p):
        own = F.when(F.col("side") == 1, F.col("v")).when((F.col("side") == 0) & (p == F.col("upto") - 1), F.col("top")).when(
            (F.col("side") == 2) & (p == F.col("first")), F.col("low"))
        return F.max(F.when((F.col("first") <= p) & (p < F.col("upto")), own))

    found = counts.groupBy(*ks, "n", "i", "h").agg(at_position(F.floor("h")).alias("lo"), at_position(F.ceil("h")).alias("hi"))
    one = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))
    wide = found.groupBy(*ks, "n").agg(*[F.max(F.when(F.col("i") == i, one)).alias(f"_q{i}") for i in range(len(qs))])
    return wide.select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], "n",
                       F.array(*[F.col(f"_q{i}") for i in range(len(qs))]).alias(out))


def quantile_frame(df: DataFrame, col: str, q: float) -> DataFrame:
    """One row, column ``value``: the exact linear-interpolated ``q`` quantile of ``col`` (nulls ignored;
    null where there is no value)."""
    return exact_quantiles(df, [], col, [q]).agg(F.max(F.col("q")[0]).alias("value"))


def quantile_scalar(df: DataFrame, col: str, q: float) -> Column:
    """The same as a scalar-subquery Column (evaluated once by Spark, lazily)."""
    return quantile_frame(df, col, q).scalar()
