"""Positions in a total order without a single-partition window.

``row_number()`` over a window with no partition key, or with a key that may hold a third
of all rows, runs in one task.  Here positions come from a distributed sort: rows are
range-partitioned on the (unique) order key - Spark samples the key, so even one hot group
is cut across many partitions - and numbered inside their partition; a row's position is
its number plus the row count of all earlier partitions (an aggregate with one row per
partition, a proven bound, broadcast).

Consistency: the counts and the numbered rows must describe the same partitioning.  Spark's
range partitioner samples with a seed tied to the RDD id, so two evaluations of the same
plan can cut differently.  The ranged rows are therefore written once, with their
partition-local numbers, to the shared checkpoint folder (``session.materialize``) and both
consumers read that one result; a retried task re-reads the same shuffle partition and
numbers it identically (the order key is unique). 
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upkeep.session import materialize

_LOW33 = (1 << 33) - 1


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(counts: DataFrame, key: str) -> DataFrame:
    w = Window.orderBy(key)  # one row per partition/bucket only
    return counts.select(
        key,
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding,
                                       Window.unboundedFollowing)).alias("_total"))


def global_positions(df: DataFrame, order: list[str], pos_col: str = "pos",
                     total_col: str | None = None,
                     num_buckets: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based position of the row in ascending ``order`` (column names
    forming a total order, unique per row).  ``total_col`` optionally carries the row
    count."""
    n = _partitions(df, num_buckets)
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # partition id in the upper bits, record number in sorted order in the lower 33
    tagged = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumns({"_bk": F.shiftright("_mid", 33),
                                 "_rn": F.col("_mid").bitwiseAND(F.lit(_LOW33)) + 1})
    counts = tagged.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    out = tagged.join(F.broadcast(_offsets(counts, "_bk")), "_bk").drop("_mid")
    out = out.withColumn(pos_col, F.col("_off") + F.col("_rn") - 1)
    if total_col:
        out = out.withColumn(total_col, F.col("_total"))
    return out.drop("_bk", "_rn", "_off", "_total")


def row_number_within(df: DataFrame, group: list[str], order: list[str], rn_col: str = "rn",
                      size_col: str | None = None, num_buckets: int | None = None
                      ) -> DataFrame:
    """``row_number() over (partition by group order by order)`` (1-based), skew-safe.

    Positions come from ``global_positions`` over (group, order); a group's first position
    is an aggregate (partial aggregation, no skew) joined back on the group key (AQE splits
    a skewed join partition, and a small group table is broadcast at runtime).
    """
    pos = global_positions(df, list(group) + list(order), pos_col="_gpos",
                           num_buckets=num_buckets)
    aggs = [F.min("_gpos").alias("_start")]
    if size_col:
        aggs.append(F.count(F.lit(1)).alias(size_col))
    starts = pos.groupBy(*group).agg(*aggs)
    cond = [pos[c].eqNullSafe(starts[c]) for c in group]
    out = pos.join(starts, cond).select(pos["*"], starts["_start"],
                                        *([starts[size_col]] if size_col else []))
    return out.withColumn(rn_col, F.col("_gpos") - F.col("_start") + 1).drop("_gpos", "_start")


def first_per_key(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Keep-first row per key (``drop_duplicates(keep='first')`` in ``order`` order).

    One aggregate: ``min_by`` of the whole row by the order columns.  Partial aggregation
    keeps at most one row per key per task before the shuffle, so a hot key costs nothing
    extra.  (``dropDuplicates`` is not deterministic about which row stays.)  Missing key
    values form their own group, as in pandas.
    """
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    ord_col = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    packed = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), ord_col).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """pandas ``merge`` matches a missing key with a missing key; SQL ``=`` does not."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond
