"""Train/test splits (W4 time order, W6 stratified, W7 keyed hash).

None of them numbers rows in one task: positions come from a range-partitioned sort and
the random parts are keyed hashes, so a split is the same under any partitioning and after
a retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.functions.keyed import uniform
from upkeep.operators.ordering import global_positions, row_number_within


def time_boundary(df: DataFrame, order: list[str], num: int, den: int):
    """The last row of the first floor(n * num / den) in ``order`` (day first): (day, rest of the order), rest
    None if the whole day belongs to them; None if there is no such row.  Rows are counted by day (the counts
    are as many as the calendar has days) and put in order inside the boundary day only."""
    day, rest = order[0], list(order[1:])
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(day)
    upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = F.floor(F.col("_total") * num / F.lit(den))
    at = (counts.withColumns({"_upto": upto, "_total": total}).withColumn("_cut", cut)
          .filter((F.col("_upto") >= F.col("_cut")) & (F.col("_upto") - F.col("_n") < F.col("_cut"))).first())
    if at is None:
        return None
    if at["_cut"] == at["_upto"] or not rest:
        return at[day], None
    inside = df.filter(F.col(day).eqNullSafe(F.lit(at[day]).cast(df.schema[day].dataType))).select(*rest)
    nth = at["_cut"] - (at["_upto"] - at["_n"]) - 1
    row = global_positions(inside, rest, pos_col="_pos").filter(F.col("_pos") == nth).first()
    return at[day], [row[c] for c in rest]


def time_split(df: DataFrame, order: list[str], train_share_num: int = 4,
               train_share_den: int = 5, flag: str = "is_train", keys: DataFrame | None = None) -> DataFrame:
    """Global time-ordered split: the first int(n*0.8) rows of the total order are train.

    ``order`` must be a total order without nulls that starts with a day (e.g. date, id, row_seq).
    int(n*0.8) equals (4n) div 5 for every n (the double 0.8 is slightly above 4/5), so integers are
    used.  The boundary is found first (``time_boundary``, from ``keys`` if given: the same rows, cheaper to
    read); the split is then a comparison per row, without sort, shuffle or copy.
    """
    found = time_boundary(df if keys is None else keys, order, train_share_num, train_share_den)
    if found is None:
        return df.withColumn(flag, F.lit(False))
    at, rest = found
    typed = lambda c, v: F.lit(v).cast(df.schema[c].dataType).alias(c)
    day = F.col(order[0])
    if rest is None:
        return df.withColumn(flag, day <= typed(order[0], at))
    last = F.struct(*[typed(c, v) for c, v in zip(order[1:], rest)])
    inside = F.struct(*[F.col(c) for c in order[1:]]) <= last
    return df.withColumn(flag, (day < typed(order[0], at)) | ((day == typed(order[0], at)) & inside))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42,
                     test_num: int = 1, test_den: int = 5, flag: str = "is_train"
                     ) -> DataFrame:
    """Per class, round(n_c * 0.2) rows (half up) go to test, chosen by a keyed hash of the
    row key; a class of one row stays in train."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    ranked = row_number_within(df.withColumn("_h", h), [label], ["_h", key],
                               rn_col="_rn", size_col="_nc")
    n_test = F.floor((F.col("_nc") * 2 * test_num + test_den) / F.lit(2 * test_den))
    return ranked.withColumn(flag, F.col("_rn") > n_test).drop("_h", "_rn", "_nc")


def hash_split(df: DataFrame, key: str, seed: int = 42, train_share: float = 0.8,
               flag: str = "is_train") -> DataFrame:
    """Random split by keyed uniform: u(key, seed) < share -> train.  Sizes are random
    (as a random split's are), membership is reproducible."""
    return df.withColumn(flag, uniform(key, seed=seed) < F.lit(train_share))
