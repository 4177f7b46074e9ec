"""Helpers shared by the text operators: shipping the package to executors, Arrow batch
handling, byte-level word splitting, hashing of word windows, connected components.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.session import Scratch

#: Text handled at once inside a task, in bytes of UTF-8 (one longer text goes alone).
SLICE_BYTES = 1 << 20

_shipped: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, wherever the session was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="upkeep-ship-")
    staged = os.path.join(folder, "src")
    shutil.copytree(os.path.join(root, "upkeep"), os.path.join(staged, "upkeep"),
                    ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "upkeep"), "zip", staged))
    _shipped.add(app)


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most about ``size`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1]
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; a null text is an empty one."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id: a hash of the (possibly null) text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores added, that no column in ``taken`` has (Spark
    compares names without regard to case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


# ---------------------------------------------------------------- word windows as hashes

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_WORD = _SPACE.copy()
_NO_WORD[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: bytes, punctuation: bool = False
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (byte offsets) of every word of a buffer, A-Z folded to lower
    case.  Words lie between x20 and x09-x0D or, with ``punctuation``, between any ASCII
    characters other than letters and digits."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    space = (_NO_WORD if punctuation else _SPACE)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = _LOWER[buf].astype(np.uint64)
    values += np.uint64(1)
    values *= power[:len(buf)]
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64) * _MULT), starts, ends


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j:j + n]
        h ^= h >> np.uint64(32)
    return mix64(h)


# ---------------------------------------------------------------- groups of linked things

def spanning_edges(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of n numbered things reduced to one link from each member of a group to the
    group's smallest member: at most n - 1 links, whatever the number given."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    members = np.flatnonzero(parent != np.arange(n))
    return members, parent[members]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (columns a, b of one orderable
    type), root being the smallest node reachable.

    Alternates two contraction steps (each node's larger neighbours, then its smaller ones,
    move to its smallest neighbour) until nothing changes, which takes a number of rounds
    logarithmic in the longest chain.  Minima are aggregated before the shuffle and joined
    back, so a node with very many links is split by the adaptive skew join; each round is
    written to the checkpoint folder, which cuts the lineage.
    """
    cur = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u != v").distinct())
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u != v").distinct())
        nxt = scratch.write(small)
        a = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        b = nxt.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        cur = nxt
        if a == b:
            break
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def with_text_column(docs: DataFrame, text_col: str, name: str, ddl: str, make) -> DataFrame:
    """``docs`` with one more column ``name`` of type ``ddl`` computed from the texts, all other
    columns untouched whatever their names.  ``make()`` runs once per task and returns a function
    from a list of UTF-8 texts (null: empty) to an Arrow array."""
    ship_package(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index(text_col.lower())]
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)]

    def run(batches):
        compute = make()
        for batch in batches:
            batch = batch.rename_columns(names)
            for part in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, compute(utf8(part, text))],
                                                 [*names, "made"])

    out = docs.toDF(*names).mapInArrow(run, ", ".join([*fields, f"made {ddl}"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)],
                      F.col("made").alias(name))
