"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 bits wide: bit i is set if it is set in over half of the hashes of a
document's word shingles.  Equal fingerprints are merged first.  The distinct ones are dealt
into tiles by the population counts of their two halves; two fingerprints at distance d differ
by at most d in the sum of the halves' population count differences, so a tile is
compared only with tiles whose population counts are within the radius.  Inside a pair of tiles,
sub-tiles sorted by the population counts of their 16-bit quarters are skipped by the same rule, and
the rest are compared exactly with numpy exclusive-or and bit counts.  Each tile pair
reports a spanning set of its links (at most one per fingerprint), which connected components
join into groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.llm.common import (connected_components, documents, ship_package, spanning_edges,
                               text_key, text_slices, utf8)
from upkeep.session import Scratch

#: Fingerprints in a tile, about; in a sub-tile; and comparisons held at once.
TILE, SUBTILE = 16384, 256


def fingerprint(data: bytes, k: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words between x20 and x09-x0D, ``k``-word shingles
    (repeats included), XXH64.  Fewer words make one shingle, none the fingerprint 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:n - 1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed)
                           for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp) for every row of ``docs``; fp holds the 64 bits as a signed long, tkey is
    the hash of the text that tells rows of one id apart."""
    ship_package(docs.sparkSession)
    keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"),
                       F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = np.array([fingerprint(t, k, seed) for t in utf8(part, "text")], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tkey"), pa.array(fp.view(np.int64))],
                    ["doc_id", "tkey", "fp"])

    return keep.mapInArrow(run, "doc_id long, tkey long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int16)


def _subtiles(fp: np.ndarray):
    """(order, bounds, least, most): fingerprints sorted by quarter counts and cut; the range of
    each quarter's count in each sub-tile."""
    q = _quarters(fp)
    order = np.lexsort(q.T)
    cuts = np.arange(0, len(fp), SUBTILE)
    q = q[order]
    return order, cuts, np.minimum.reduceat(q, cuts), np.maximum.reduceat(q, cuts)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (pairs of fingerprints) of all pairs of ``a`` x ``b`` within ``radius``."""
    if not len(a) or not len(b):
        return a[:0], b[:0]
    both = np.concatenate([a, b])
    oa, ca, la, ma = _subtiles(a)
    ob, cb, lb, mb = _subtiles(b)
    u, v, held = [], [], 0
    for i, lo in enumerate(ca):
        # least possible distance to every sub-tile of b, quarter by quarter
        gap = np.maximum(0, np.maximum(la[i] - mb, lb - ma[i])).sum(axis=1)
        rows = oa[lo:lo + SUBTILE]
        for lo_b in cb[gap <= radius]:
            cols = ob[lo_b:lo_b + SUBTILE]
            near = np.bitwise_count(a[rows][:, None] ^ b[cols][None, :]) <= radius
            x, y = np.nonzero(near)
            u.append(rows[x])
            v.append(cols[y] + len(a))
            held += len(x)
        if held > 1 << 20:  # keep a spanning set only
            m, r = spanning_edges(len(both), np.concatenate(u), np.concatenate(v))
            u, v, held = [m], [r], 0
    if not u:
        return a[:0], b[:0]
    m, r = spanning_edges(len(both), np.concatenate(u), np.concatenate(v))
    return both[m], both[r]


def near_links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span all pairs of the distinct fingerprints (column fp) within
    ``radius`` bits of each other."""
    spark = distinct.sparkSession
    half = 0xFFFFFFFF
    cells = distinct.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"),
                            F.bit_count(F.col("fp").bitwiseAND(F.lit(half))).alias("lo"))
    # at most 33 x 33 cells; a cell's tiles follow from its count
    counts = cells.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("hi", "lo", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    tiles = (cells.join(F.broadcast(counts), ["hi", "lo"])
             .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
             .groupBy("hi", "lo", "tile").agg(F.collect_list("fp").alias("fps")))
    # each tile meets itself, later tiles of its cell, and the cells on one side of it
    steps = [(dh, dl) for dh in range(radius + 1) for dl in range(-radius, radius + 1)
             if dh + abs(dl) <= radius and (dh, dl) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("dh"), F.lit(x).alias("dl")) for h, x in steps]))
    left = (tiles.select("hi", "lo", "tile", "fps", step.alias("step"))
            .select(F.col("fps").alias("left"), F.col("tile").alias("left_tile"),
                    ((F.col("step.dh") == 0) & (F.col("step.dl") == 0)).alias("same"),
                    (F.col("hi") + F.col("step.dh")).alias("hi"),
                    (F.col("lo") + F.col("step.dl")).alias("lo"))
            .join(F.broadcast(counts), ["hi", "lo"])
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .filter("not same or left_tile <= tile"))
    pairs = left.join(tiles, ["hi", "lo", "tile"]).select("left", F.col("fps").alias("right"))
    ship_package(spark)

    def run(batches):
        for batch in batches:
            a, b = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
                m, r = tile_links(x, y, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(r.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").filter("a != b").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", tile: int = TILE,
                    scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``tkey`` (hash of the text), ``fp`` (signed long),
    ``component_id``, the smallest id among the documents reachable over links of at most
    ``radius`` bits, and ``first``: whether the row is the component's first by id (null last),
    then text hash.

    A null text counts as empty; empty texts have fingerprint 0 and are linked like any other;
    repeated rows stay repeated and are all first, or none; rows with a null id link but never give
    a component its id (a component of null ids only has a null id); other columns are ignored
    whatever their names.  Runs Spark jobs and writes to the checkpoint folder; a ``scratch`` of the
    caller's lets it delete those tables once the result is stored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, k, seed, id_col, text_col))
    # one row per distinct fingerprint, whatever the size of its group of copies
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    distinct = scratch.write(fps.groupBy("fp").agg(F.min(row).alias("head")))
    roots = connected_components(near_links(distinct.select("fp"), radius, tile), scratch)
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("head").alias("top"))
    moved = linked.join(lowest, "root").select("fp", "top")
    groups = distinct.join(moved, "fp", "left").select("fp", F.coalesce("top", "head").alias("top"))
    return fps.join(groups, "fp").select(
        "doc_id", "tkey", "fp", F.col("top.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tkey") == F.col("top.tkey"))).alias("first"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` calls first, all columns as they are; of rows
    equal in id and text one stays."""
    ident = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): p for c, p in zip(docs.columns, plain)}
    own = docs.toDF(*plain).withColumns({"k": ident(F.col(at[id_col.lower()])),
                                         "tkey": text_key(F.col(at[text_col.lower()]))})
    reps = found.filter("first").select(ident(F.col("doc_id")).alias("k"), "tkey")
    kept = own.join(reps, ["k", "tkey"], "left_semi")  # the window below needs no other shuffle
    number = F.row_number().over(Window.partitionBy("k", "tkey").orderBy("tkey"))
    return kept.withColumn("number", number).filter("number = 1").select(
        *[F.col(p).alias(c) for c, p in zip(docs.columns, plain)])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")
