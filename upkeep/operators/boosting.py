"""Multiclass gradient boosting of trees over features that are binned once (M1).

The rows become cells: one row per combination of bins, with its number of rows of every class, so a
hot combination costs one row.  Each level of a round needs one aggregate, the sums of gradients and
hessians per (class, node, feature, bin), for the trees of all classes together; its size depends on
the parameters alone, and the splits are chosen from it on the driver.

Cells lie in blocks of bounded size in a table.  Where one block holds them all (its size is known from
a count), the aggregate is taken over that block in place; otherwise by a Spark job over the cached blocks, whose
margins are written anew every few rounds.  Both give the same sums.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.session import Scratch, ship_package

#: Cells in a block, about; rounds between two writes of the margins.
BLOCK_CELLS, MARGIN_ROUNDS = 1 << 16, 10


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``columns`` are the shares of cells and features that a tree sees (keyed draws)."""
    rounds: int = 200
    depth: int = 7
    rate: float = 0.1
    min_hessian: float = 3.0
    l2: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = 42


# ---------------------------------------------------------------- trees as arrays

@dataclass
class Trees:
    """Trees of one class each in heap order: children of node i are 2i + 1 (bin <= cut) and 2i + 2; ``feature``
    is -1 at a leaf, whose ``value`` counts.  Arrays are (trees, 2 ** (depth + 1) - 1)."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(n: int, depth: int) -> "Trees":
        size = (n, 2 ** (depth + 1) - 1)
        return Trees(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node (trees, rows) that every row (rows, features) has come to after ``depth`` levels."""
        node = np.zeros((len(self.feature), len(bins)), np.int64)
        for _ in range(depth):
            f = np.take_along_axis(self.feature, node, 1)
            b = bins[np.arange(len(bins)), np.maximum(f, 0)]
            down = 2 * node + 1 + (b > np.take_along_axis(self.cut, node, 1))
            node = np.where(f >= 0, down, node)
        return node

    def margins(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.take_along_axis(self.value, self.leaves(bins, depth), 1)


def _draw(keys: np.ndarray, salt: int) -> np.ndarray:
    """Keyed uniform draws in [0, 1)."""
    x = keys.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def gradients(margins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the softmax loss, (classes, cells), summed over the rows of a cell."""
    e = np.exp(margins - margins.max(axis=0))
    p = e / e.sum(axis=0)
    n = counts.sum(axis=0)
    return n * p - counts, 2.0 * n * p * (1 - p)


def histogram(bins: np.ndarray, counts: np.ndarray, keys: np.ndarray, margins: np.ndarray, trees: Trees,
              level: int, n_bins: int, s: Settings, number: int) -> np.ndarray:
    """Sums (2, classes, nodes of the level, features, bins) over the cells that this round sees; of the last
    level for the first feature alone."""
    seen = _draw(keys, s.seed * 1_000_003 + number) < s.rows
    bins, counts, margins = bins[seen], counts[:, seen], margins[:, seen]
    g, h = gradients(margins, counts)
    k, f = len(counts), bins.shape[1]
    first, width = 2 ** level - 1, 2 ** level
    used = f if level < s.depth else 1  # the last level's nodes are not split: their totals will do
    columns = np.ascontiguousarray(bins.T[:used])
    out = np.zeros((2, k, width, used, n_bins))
    for c in range(k):
        one = Trees(*(x[c:c + 1] for x in (trees.feature, trees.cut, trees.value)))
        node = one.leaves(bins, level)[0] - first
        live = np.flatnonzero((node >= 0) & (node < width))  # others rest in a leaf above
        place, sums = node[live] * n_bins, (g[c, live], h[c, live])
        for j in range(used):
            at = place + columns[j, live]
            for i, x in enumerate(sums):
                out[i, c, :, j] = np.bincount(at, x, width * n_bins).reshape(width, n_bins)
    return out


def grow(sums, classes: int, features: int, s: Settings, number: int) -> Trees:
    """One tree per class from ``sums(trees, level)``, the histograms of a level."""
    trees = Trees.empty(classes, s.depth)
    allowed = np.stack([_draw(np.arange(features), s.seed + 7919 * (number * classes + c)) for c in range(classes)])
    allowed = allowed.argsort(axis=1).argsort(axis=1) < max(1, int(s.columns * features))
    for level in range(s.depth + 1):
        first = 2 ** level - 1
        g, h = sums(trees, level)
        total_g, total_h = g[:, :, 0].sum(axis=2), h[:, :, 0].sum(axis=2)
        here = slice(first, first + g.shape[1])
        trees.value[:, here] = -s.rate * total_g / (total_h + s.l2)
        if level == s.depth:
            break
        left_g, left_h = g.cumsum(axis=3)[..., :-1], h.cumsum(axis=3)[..., :-1]
        right_g, right_h = total_g[..., None, None] - left_g, total_h[..., None, None] - left_h
        gain = left_g ** 2 / (left_h + s.l2) + right_g ** 2 / (right_h + s.l2) - (total_g ** 2 / (total_h + s.l2))[..., None, None]
        ok = (left_h >= s.min_hessian) & (right_h >= s.min_hessian) & allowed[:, None, :, None]
        gain = np.where(ok, gain, 0).reshape(*gain.shape[:2], -1)
        best = gain.argmax(axis=2)
        split = np.take_along_axis(gain, best[..., None], 2)[..., 0] > 1e-9
        trees.feature[:, here] = np.where(split, best // left_g.shape[3], -1)
        trees.cut[:, here] = np.where(split, best % left_g.shape[3], 0)
        if not split.any():
            break
    return trees


# ---------------------------------------------------------------- binning and cells

def fit_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper bounds of the bins of every feature: its values where there are few, else quantiles."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    row = doubles.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, at, F.lit(100 * bins)))).alias(c) for c in features]).first()
    return [list(row[c] or []) for c in features]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]]) -> list:
    """A column per feature: the number of its bounds below the value plus one; 0 for a missing value."""
    out = []
    for c, bounds in zip(features, cuts):
        x = F.col(c).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b < x))
        out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(below + 1).cast("int"))
    return out


def _cells(df: DataFrame, features: list[str], cuts, label: str, classes: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    names = [f"b{i}" for i in range(len(features))]
    rows = df.select(*[b.alias(n) for n, b in zip(names, binned(df, features, cuts))], F.col(label).alias("y"))
    cells = rows.groupBy(*names).agg(F.array(*[F.count_if(F.col("y") == c) for c in classes]).alias("counts"))
    cells = scratch.write(cells.select(F.array(*names).alias("bins"), "counts", F.xxhash64(*names).alias("key")))
    return cells, cells.count()


def _arrays(table: pa.Table, features: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lambda c, n: table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n)
    return (flat("bins", features).astype(np.int64), flat("counts", classes).T.astype(float),
            table.column("key").to_numpy().view(np.uint64))


_BLOCK = "block long, bins binary, counts binary, keys binary, margins binary"


class _Blocks:
    """Cells in several blocks, one to a task: every level is one job, whose tasks add the sums of their blocks; the
    driver adds those of at most one task a core.  The margins go on with every round in the cached blocks, and are written every few rounds."""

    def __init__(self, cells: DataFrame, n: int, classes: int, features: int, s: Settings, scratch: Scratch):
        self.k, self.f, self.s, self.scratch, self.n = classes, features, s, scratch, -(-n // BLOCK_CELLS)
        self.spark = cells.sparkSession
        self.tasks = max(16, self.spark.sparkContext.defaultParallelism)
        ship_package(self.spark)

        def pack(table):
            block, table = table.column("block")[0].as_py(), table.sort_by("key")
            bins, counts, keys = _arrays(table, features, classes)
            return pa.table({"block": pa.array([block]), "bins": pa.array([bins.astype("<i2").tobytes()]),
                             "counts": pa.array([counts.astype("<f8").tobytes()]), "keys": pa.array([keys.tobytes()]),
                             "margins": pa.array([np.zeros((classes, len(keys))).tobytes()])})

        self.old, self.rounds = [], 0
        self.rows = self._dealt(cells.withColumn("block", F.pmod("key", F.lit(self.n))).groupBy("block").applyInArrow(
            lambda t: pack(t.select(["block", "bins", "counts", "key"])), _BLOCK))

    def _dealt(self, table: DataFrame):
        """The blocks of ``table``, written, one to a partition."""
        table = self.scratch.write(table).repartitionByRange(self.n, "block")
        return table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, trees: Trees, level: int, n_bins: int, number: int) -> np.ndarray:
        s, opened = self.s, _opener(self.f, self.k)
        sums = self.rows.coalesce(self.tasks).map(lambda raw: histogram(*opened(raw), trees, level, n_bins, s, number))
        out = sums.reduce(np.add)
        while self.old:  # the margins that this job has read stand on their own now
            self.old.pop().unpersist()
        return out

    def add(self, trees: Trees) -> None:
        depth, opened = self.s.depth, _opener(self.f, self.k)

        def moved(raw):
            bins, _, _, margins = opened(raw)
            return (*raw[:4], bytearray((margins + trees.margins(bins, depth)).tobytes()))

        before, self.rounds = self.rows, self.rounds + 1
        self.rows = before.map(moved)
        if self.rounds % MARGIN_ROUNDS:
            self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.rows = self._dealt(self.spark.createDataFrame(self.rows, _BLOCK, verifySchema=False))
        self.old.append(before)

    def close(self) -> None:
        for rows in (*self.old, self.rows):
            rows.unpersist()


def _opener(features: int, classes: int):
    """Arrays (bins, counts, keys, margins) of a block's row."""
    def opened(raw):
        return (np.frombuffer(raw[1], "<i2").reshape(-1, features).astype(np.int64),
                np.frombuffer(raw[2]).reshape(classes, -1), np.frombuffer(raw[3], np.uint64),
                np.frombuffer(raw[4]).reshape(classes, -1))

    return opened


class _OneBlock:
    """Cells that one block holds."""

    def __init__(self, cells: DataFrame, classes: int, features: int, s: Settings):
        self.bins, self.counts, self.keys = _arrays(cells.orderBy("key").toArrow(), features, classes)
        self.margins, self.s = np.zeros((classes, len(self.keys))), s

    def sums(self, trees: Trees, level: int, n_bins: int, number: int) -> np.ndarray:
        return histogram(self.bins, self.counts, self.keys, self.margins, trees, level, n_bins, self.s, number)

    def add(self, trees: Trees) -> None:
        self.margins += trees.margins(self.bins, self.s.depth)

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- the model

class BoostedTrees:
    """A fitted model: features, bounds of their bins, classes, and trees round by round."""

    def __init__(self, features: list[str], cuts: list[list[float]], classes: list[str], depth: int, trees: Trees):
        self.features, self.cuts, self.classes, self.depth, self.trees = features, cuts, classes, depth, trees

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the most probable class; ties go to the first class."""
        ship_package(df.sparkSession)
        kept = [f"c{i}" for i in range(len(df.columns))]
        rows = df.withColumn("_bins", F.array(*binned(df, self.features, self.cuts)))
        fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, df.schema.fields)]
        trees, depth, k, f, classes = self.trees, self.depth, len(self.classes), len(self.features), self.classes

        def run(batches):
            for batch in batches:
                bins = batch.column(len(kept)).flatten().to_numpy().reshape(-1, f).astype(np.int64)
                score = np.zeros((k, len(bins)))
                for lo in range(0, len(trees.feature), k):
                    one = Trees(*(x[lo:lo + k] for x in (trees.feature, trees.cut, trees.value)))
                    score += one.margins(bins, depth)
                said = pa.array([classes[i] for i in score.argmax(axis=0)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], said], [*kept, "said"])

        out = rows.toDF(*kept, "bins").mapInArrow(run, ", ".join([*fields, "said string"]))
        return out.select(*[F.col(n).alias(c) for n, c in zip(kept, df.columns)], F.col("said").alias(name))

    def importance(self) -> dict[str, float]:
        """Share of splits by feature."""
        used = np.bincount(self.trees.feature[self.trees.feature >= 0], minlength=len(self.features))
        return dict(zip(self.features, (used / max(1, used.sum())).tolist()))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per tree and one with the rest: bounded by the settings."""
        head = json.dumps({"features": self.features, "cuts": self.cuts, "classes": self.classes, "depth": self.depth})
        rows = [(-1, head, None, None, None)] + [
            (i, None, f.tolist(), c.tolist(), v.tolist()) for i, (f, c, v) in enumerate(
                zip(self.trees.feature, self.trees.cut, self.trees.value))]
        return spark.createDataFrame(rows, "tree int, head string, feature array<int>, cut array<int>, value array<double>").coalesce(1)

    @staticmethod
    def from_table(table: DataFrame) -> "BoostedTrees":
        first, *rows = table.orderBy("tree").collect()
        return BoostedTrees(**json.loads(first.head), trees=Trees(
            np.array([r.feature for r in rows], np.int16), np.array([r.cut for r in rows], np.int16),
            np.array([r.value for r in rows], float)))


def fit(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), one_block: bool | None = None) -> BoostedTrees:
    """Fit to the rows of ``df`` whose label is not missing; a missing feature value has a bin of its own.
    ``one_block`` chooses how sums are taken (None: by the number of cells)."""
    spark, s = df.sparkSession, settings
    with Scratch(spark) as scratch:
        df = df.filter(F.col(label).isNotNull())
        classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # classes are few
        if not classes:
            raise ValueError(f"no row with a {label} to fit to")
        cuts = fit_cuts(df, features, s.bins)
        n_bins = 2 + max(map(len, cuts))
        cells, n = _cells(df, features, cuts, label, classes, scratch)
        if one_block if one_block is not None else n <= BLOCK_CELLS:
            source = _OneBlock(cells, len(classes), len(features), s)
        else:
            source = _Blocks(cells, n, len(classes), len(features), s, scratch)
        grown = []
        for number in range(s.rounds):
            trees = grow(lambda t, level: source.sums(t, level, n_bins, number), len(classes), len(features), s, number)
            source.add(trees)
            grown.append(trees)
        source.close()
    return BoostedTrees(list(features), cuts, classes, s.depth,
                        Trees(*(np.concatenate([getattr(t, a) for t in grown]) for a in ("feature", "cut", "value"))))
