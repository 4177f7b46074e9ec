"""Hard-negative mining with anchor-clustered shared lists (after MAXIMUS, Abuzaid et al. 2019), exact.

Anchors are clustered by direction.  For a cluster whose members lie within an angle b of its centre, no
member u can score an item i above ||u|| ||i|| cos(max(0, angle(i, centre) - b)).  The items are sorted
by that bound (without ||u||) once per cluster, and every member walks the one list in blocks until the
next bound, times its own length, is below the worst score that it still needs: its stop is
certified, nothing is approximated.

In Spark, items are dealt into tiles of bounded size by a hash of their id, anchors into chunks of whole
clusters (parts of one, if it is large), and each pair of a chunk and a tile is walked by itself;
what it finds (at most a few rows per anchor) is ranked per anchor.  The work is the number of anchors times
the number of items, less what the certified stops save.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.llm.common import ship_package
from upkeep.session import Scratch

#: Items in a tile and anchors in a chunk, about.
TILE, CHUNK = 16_384, 2_048
#: Anchors in a cluster, about; most clusters; most anchors (by hash of their id) that centres are fitted to.
CLUSTER, MAX_CLUSTERS, SAMPLE = 64, 4_096, 16_384
#: Most partitions over pairs of chunk and tile.
MAX_TASKS = 8_192
#: Items in the first and in later blocks of a walk.
FIRST_BLOCK, BLOCK = 64, 1_024
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---------------------------------------------------------------- one cluster and one tile

def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    out = np.divide(x, norm, out=np.zeros_like(x, dtype=np.float64), where=norm > 0)
    out[norm[..., 0] == 0, :1] = 1.0  # any direction bounds a zero vector
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer matrices."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2 ** 52:  # no partial sum leaves the integers that a double holds
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2 ** 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("scores of these vectors do not fit 64 bits")


def _percent(p: int, x: np.ndarray) -> np.ndarray:
    """floor(p * x / 100) without leaving 64 bits."""
    return p * (x // 100) + p * (x % 100) // 100


class SharedList:
    """The items of a tile by the angular upper bound for a cluster's members, highest first."""

    def __init__(self, members: np.ndarray, centre: np.ndarray, items: np.ndarray):
        angle = lambda x: np.arccos(np.clip(_unit(x) @ centre, -1, 1))
        spread = angle(members).max(initial=0)
        bound = np.linalg.norm(items, axis=1) * np.cos(np.maximum(0, angle(items) - spread))
        self.order = np.argsort(-bound)
        self.bound = bound[self.order]

    def limit(self, at: int, norms: np.ndarray) -> np.ndarray:
        """The most that members of these lengths can score with any item from ``at`` on."""
        top = self.bound[at]
        return norms * top + 1e-9 * norms * abs(top) + 0.5


def _best(row: np.ndarray, score: np.ndarray, item: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k highest scores of every row, ties by smaller id; and each entry's rank."""
    order = np.lexsort((ids[item], -score, row))
    row, score, item = row[order], score[order], item[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = rank < k
    return row[keep], score[keep], item[keep], rank[keep]


def walk(members: np.ndarray, shared: SharedList, items: np.ndarray, ids: np.ndarray, wanted, owner: np.ndarray,
         low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For every list r (of member ``owner[r]``) the k best items with a score from low[r] to high[r] among
    those that ``wanted(member numbers, item numbers)`` (a mask) lets it have: (r, score, item), and the
    number of scores computed.  A member stops when no item to come can enter any of its lists."""
    floor = low.copy()
    norms = np.linalg.norm(members.astype(float), axis=1)
    held = (np.empty(0, np.int64),) * 3
    active, at, size, computed = np.arange(len(members)), 0, FIRST_BLOCK, 0
    while at < len(items) and len(active):
        block = shared.order[at:at + size]
        at, size = at + len(block), min(2 * size, BLOCK)
        s = scores(members[active], items[block])
        computed += s.size
        mask = wanted(active, block)
        place = np.full(len(members), -1)
        place[active] = np.arange(len(active))
        lists = np.flatnonzero(place[owner] >= 0)
        of = place[owner[lists]]
        seen = s[of]
        r, c = np.nonzero((seen >= floor[lists, None]) & (seen <= high[lists, None]) & mask[of])
        if len(r):
            row, score, item, rank = _best(np.concatenate((held[0], lists[r])), np.concatenate((held[1], seen[r, c])),
                                           np.concatenate((held[2], block[c])), ids, k)
            held = row, score, item
            full = rank == k - 1
            floor[row[full]] = score[full]  # an equal score may still win by its id
        if at < len(items):
            need = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(need, owner, floor)
            active = active[shared.limit(at, norms[active]) >= need[active]]
    return *held, computed


# ---------------------------------------------------------------- tiles and chunks

def _matrix(vectors: pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    """Integer matrix of a list column; shorter vectors are padded with zeros."""
    flat = vectors.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    lengths = np.array(flat.value_lengths().to_pylist(), np.int64)
    out = np.zeros((len(lengths), dim), dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _packed(rows: DataFrame, key: str, dim: int, dtype: str, anchors: bool) -> DataFrame:
    """One row per value of ``key``: ids, labels and vectors (and, for anchors, clusters, positives and their
    number) as packed binaries."""
    schema = f"{key} int, ids binary, labels binary, vectors binary"
    schema += ", clusters binary, counts binary, positives binary, scores binary" * anchors

    def pack(table):
        table = table.sort_by("vec_id")
        column = lambda n, t: table.column(n).to_numpy().astype(t).tobytes()
        out = [table.column(key)[0].as_py(), column("vec_id", "<i8"), column("label", "<i8"),
               _matrix(table.column("q"), dim, dtype).tobytes()]
        if anchors:
            found = [p or [] for p in table.column("positives").to_pylist()]
            out += [column("cluster", "<i4"), np.array([len(p) for p in found], "<i4").tobytes(),
                    np.array([x["vec_id"] for p in found for x in p], "<i8").tobytes(),
                    np.array([x["score"] for p in found for x in p], "<i8").tobytes()]
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names=names)

    return rows.groupBy(key).applyInArrow(pack, schema)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``k`` clusters by direction (spherical k-means); rows in the order given seed it."""
    x = _unit(sample.astype(float))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)] if len(x) else np.zeros((0, x.shape[1]))
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def _clustered(anchors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``anchors`` (vec_id, label, q) with the number of the nearest centre."""
    schema = "vec_id long, label long, q array<long>, cluster int"

    def run(batches):
        for batch in batches:
            x = _unit(_matrix(pa.chunked_array([batch.column("q")]), dim, "<i8").astype(float))
            near = pa.array((x @ centres.T).argmax(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], ["vec_id", "label", "q", "cluster"])

    return anchors.select("vec_id", "label", "q").mapInArrow(run, schema)


def _chunked(anchors: DataFrame) -> tuple[DataFrame, int]:
    """``anchors`` with the number of their chunk, and how many there are: whole clusters in
    order, or parts of one that exceeds CHUNK."""
    spark = anchors.sparkSession
    sizes = anchors.groupBy("cluster").count().orderBy("cluster").collect()  # MAX_CLUSTERS rows at most
    plan, chunk, room = [], -1, 0
    for cluster, n in sizes:
        parts = -(-n // CHUNK)
        if n > room:
            chunk, room = chunk + 1, CHUNK
        plan.append((cluster, chunk, parts))
        chunk, room = chunk + parts - 1, (room - n if parts == 1 else 0)
    places = spark.createDataFrame(plan, "cluster int, first int, parts int")
    out = anchors.join(F.broadcast(places), "cluster").withColumn(
        "chunk", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
    return out.drop("first", "parts"), chunk + 1


def _pair_rows(tiles: DataFrame, n_tiles: int, chunks: DataFrame, n_chunks: int, centres: np.ndarray, dim: int,
               dtype: str, schema: str, find) -> DataFrame:
    """What ``find`` returns (columns of ``schema``) for every cluster of a chunk and tile, all pairs of them."""
    tasks = min(MAX_TASKS, max(1, n_tiles * n_chunks))
    both = (tiles.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_chunks - 1)))))
            .select("tile", "chunk", *[F.col(c).alias(f"item_{c}") for c in ("ids", "labels", "vectors")])
            .repartition(tasks, "tile", "chunk")
            .join(chunks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_tiles - 1)))))
                  .repartition(tasks, "tile", "chunk"), ["tile", "chunk"])).drop("tile", "chunk")
    names = [f.split()[0] for f in schema.split(", ")]
    ship_package(tiles.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                item = [np.frombuffer(raw["item_" + n], "<i8") for n in ("ids", "labels")]
                items = np.frombuffer(raw["item_vectors"], dtype).reshape(len(item[0]), dim)
                ids, labels = (np.frombuffer(raw[n], "<i8") for n in ("ids", "labels"))
                clusters, counts = (np.frombuffer(raw[n], "<i4") for n in ("clusters", "counts"))
                positives, ps = (np.frombuffer(raw[n], "<i8") for n in ("positives", "scores"))
                vectors = np.frombuffer(raw["vectors"], dtype).reshape(len(ids), dim)
                owners = np.repeat(np.arange(len(ids)), counts)
                for cluster in np.unique(clusters):
                    who = np.flatnonzero(clusters == cluster)
                    mine = np.isin(owners, who)
                    shared = SharedList(vectors[who], centres[cluster], items)
                    found = find(ids[who], labels[who], vectors[who], shared, *item, items,
                                 np.searchsorted(who, owners[mine]), positives[mine], ps[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    return both.mapInArrow(run, schema)


def mine_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10,
                   low_percent: int = 30, high_percent: int = 90, scratch: Scratch | None = None,
                   tile: int = TILE) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id long, label long, q array<long>; other columns are
    ignored): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor; higher comes first, ties by smaller
    id.  An anchor's positives are its best ``n_positives`` other rows of the same label; a positive's
    negatives are the best ``n_negatives`` rows of other labels whose score is ``low_percent`` to
    ``high_percent`` of the positive's, with whom it appears in one row each (fewer, or none, if there
    are not enough).

    Rows with a null id, label, vector or component take no part.  Of rows that share an id the first by
    label, then vector, counts.  Shorter vectors are padded with zeros.  An empty table, or one
    without anchors, gives no rows; scores beyond 64 bits raise an error.  Runs Spark jobs and writes to
    the checkpoint folder.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("q", lambda x: x.isNotNull())
    items = scratch.write(
        rows.filter(whole).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
        .groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q"))).alias("s"),
                               F.max("is_anchor").alias("is_anchor"))
        .select("vec_id", "s.label", "s.q", "is_anchor"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("q")).alias("dim"),
                     F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most")).first()
    if not size["anchors"]:
        return spark.createDataFrame([], RESULT_SCHEMA)
    dim, most = size["dim"] or 0, size["most"] or 0
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    n_tiles = max(1, -(-size["n"] // tile))
    ship_package(spark)

    sample = (items.filter("is_anchor").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow())
    k = min(MAX_CLUSTERS, -(-size["anchors"] // CLUSTER), sample.num_rows)
    centres = fit_centres(_matrix(sample.column("q"), dim, "<i8"), k)
    anchors, n_chunks = _chunked(scratch.write(_clustered(items.filter("is_anchor"), centres, dim)))
    in_tile = items.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int"))
    tiles = scratch.write(_packed(in_tile.select("tile", "vec_id", "label", "q"), "tile", dim, dtype, anchors=False))

    def positives(ids, labels, vectors, shared, item_ids, item_labels, items, *_):
        same = lambda m, i: (labels[m][:, None] == item_labels[i]) & (ids[m][:, None] != item_ids[i])
        every, ends = np.arange(len(ids)), np.iinfo(np.int64)
        r, s, i, _n = walk(vectors, shared, items, item_ids, same, every, np.full(len(ids), ends.min),
                           np.full(len(ids), ends.max), n_positives)
        return ids[r], item_ids[i], s

    none = F.array().cast("array<struct<vec_id:bigint,score:bigint>>")
    chunks = _packed(anchors.withColumn("positives", none), "chunk", dim, dtype, anchors=True)
    near = _pair_rows(tiles, n_tiles, chunks, n_chunks, centres, dim, dtype, "anchor_id long, vec_id long, score long", positives)
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(by_anchor)).filter(F.col("place") <= n_positives)
    near = scratch.write(near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives")))

    def negatives(ids, labels, vectors, shared, item_ids, item_labels, items, owners, positives, ps):
        other = lambda m, i: labels[m][:, None] != item_labels[i]
        low, high = -_percent(low_percent, -ps), _percent(high_percent, ps)
        r, s, i, _n = walk(vectors, shared, items, item_ids, other, owners, low, high, n_negatives)
        return ids[owners[r]], positives[r], item_ids[i], ps[r], s

    paired = anchors.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _pair_rows(tiles, n_tiles, _packed(paired, "chunk", dim, dtype, anchors=True), n_chunks, centres, dim, dtype,
                       "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", negatives)
    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(by_pair)).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): components x as floor(256 * x); rows with a null label or vector, or a component
    that is null or not finite, left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return embeddings.filter(good).select("vec_id", F.col("label").cast("long").alias("label"), q.alias("q"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
