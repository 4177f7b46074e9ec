"""Per-asset event history (W1 previous gap, W2 running number, W3 max of last three)
without one task per asset.

A plain ``Window.partitionBy(asset)`` puts every complaint of an asset into one task; an
asset holding a third of all rows would make that task a third of the job.  Here the rows are
range-partitioned by (asset, date, seq) - Spark samples the order, so a hot asset is cut
across many partitions whatever its dates and order keys look like - and windowed inside
(partition, asset).  One summary row per (partition, asset), carried over the partitions of each
asset, then gives every row what came before its partition.  All assets but those that
a partition bound cuts lie in one partition, so the summary has at most partitions + assets rows,
and an asset at most as many as there are partitions.  Only the first asset of a partition can have rows
before it: what is carried over has fewer rows than there are partitions and is broadcast.

The windowed rows are written once to the checkpoint folder with their partition number: the rows
and the summaries must see one partitioning, and Spark may cut another way on a second evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.session import materialize


def partition_summary(rows: DataFrame, key: str, date: str, seq: str, sev: str) -> DataFrame:
    """One row per (``_part``, key): how many rows, the last date, the last severity and the one before."""
    at = F.struct(date, seq)
    return rows.groupBy("_part", key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(date).alias("_last"),
        F.max_by(sev, at).alias("_l1"), F.max_by("_s1", at).alias("_l2"))


def ranged_rows(df: DataFrame, key: str, date: str, seq: str, sev: str, partitions: int | None = None) -> DataFrame:
    """``df`` with its range partition (``_part``) and, within (partition, key) in the order (date, seq),
    the running number, the two severities before and the date before."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, key, date, seq).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", key).orderBy(date, seq)
    return materialize(rows.withColumns({"_rn": F.row_number().over(w), "_s1": F.lag(sev, 1).over(w),
                                         "_s2": F.lag(sev, 2).over(w), "_d1": F.lag(date).over(w)}))


def history_features(df: DataFrame, key: str = "id", date: str = "tanggal",
                     seq: str = "row_seq", sev: str = "severity_num",
                     partitions: int | None = None) -> DataFrame:
    """Add ``running_number`` (1-based), ``gap_days`` (days since the previous row of the
    key, null for the first) and ``max_sev_3`` (max of ``sev`` over the row and the two
    before it).  Order inside a key: (date, seq); rows must have non-null key and date, and
    ``seq`` must be unique within (key, date)."""
    rows = ranged_rows(df, key, date, seq, sev, partitions)
    wc = Window.partitionBy(key).orderBy("_part")
    before = partition_summary(rows, key, date, seq, sev).select(
        "_part", key,
        F.coalesce(F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(wc).alias("_pd"),
        F.lag("_l1").over(wc).alias("_p1"),
        F.when(F.lag("_n").over(wc) >= 2, F.lag("_l2").over(wc)).otherwise(F.lag("_l1", 2).over(wc)).alias("_p2"))
    before = before.filter("_before > 0")  # fewer than partitions
    rn = F.col("_rn")
    prev1 = F.when(rn >= 2, F.col("_s1")).otherwise(F.col("_p1"))
    prev2 = F.when(rn >= 3, F.col("_s2")).when(rn == 2, F.col("_p1")).otherwise(F.col("_p2"))
    return (rows.join(F.broadcast(before), ["_part", key], "left").withColumns({
                "running_number": (F.coalesce("_before", F.lit(0)) + rn).cast("long"),
                "gap_days": F.datediff(F.col(date), F.when(rn == 1, F.col("_pd")).otherwise(F.col("_d1"))),
                "max_sev_3": F.greatest(F.col(sev), prev1, prev2)})
            .select(*df.columns, "running_number", "gap_days", "max_sev_3"))
