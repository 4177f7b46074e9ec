"""Periodic runs of words by enumeration of maximal pairs.

A maximal pair (i, j, l) says that the l words from i and from j on are equal, while the words before
and after them differ.  Such a pair with j - i <= l is exactly a stretch [i, j + l) whose words lie
j - i apart and which no neighbouring word extends, so nothing has to be extended or verified.  The
pairs come from the suffix array of a text: its LCP-interval tree is walked bottom-up, every node keeps
its suffixes in one list per left word, children are merged small to large, and a suffix is paired
with those of the other children that have another left word and lie near enough.

Runs need equal stretches of some least length (the least depth), so only groups of suffixes that begin
with the same that many words, under two left words at least, are walked; texts without such a group
have no run and are not sorted.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, mix64, window_hashes, with_text_column

RUNS_TYPE = ("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,"
             "best:struct<start:bigint,length:bigint,period:bigint>,collapsed:string>")


def least_depth(min_length: int, min_exponent: int) -> int:
    """The least length of equal stretches that a run needs, over all periods."""
    return min(max((min_exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of a text of word numbers, by prefix doubling: lcp[k] is the common
    prefix of the suffixes order[k - 1] and order[k]."""
    n = len(codes)
    levels, step = [], 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        levels.append((step, np.append(rank, -1)))
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1  # a text's end comes first
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            break
    lcp, i, j = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for step, rank in reversed(levels):
        same = rank[i] == rank[j]
        by = same * step
        lcp[1:] += by
        i += by
        j += by
    return order, lcp


class _Node:
    """Suffixes below a node of the tree: all in order, and in order per left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int):
        self.all, self.by_left = [position], {left: [position]}

    def others(self, position: int, left: int, reach: int):
        """The suffixes within ``reach`` of ``position`` that have another left word."""
        lo, hi = bisect_left(self.all, position - reach), bisect_right(self.all, position + reach)
        if lo == hi:
            return
        if hi - lo <= len(self.by_left):
            own = self.by_left.get(left, ())
            for p in self.all[lo:hi]:
                k = bisect_left(own, p)
                if k == len(own) or own[k] != p:
                    yield p
            return
        for word, places in self.by_left.items():
            if word != left:
                yield from places[bisect_left(places, position - reach):bisect_right(places, position + reach)]


def _merge(a: _Node, b: _Node, depth: int, min_length: int, min_exponent: int, found: dict) -> _Node:
    """The node of two children whose suffixes agree in exactly ``depth`` words; runs go to ``found``."""
    small, big = (a, b) if len(a.all) <= len(b.all) else (b, a)
    reach = depth // (min_exponent - 1)
    several = len(small.by_left) > 1 or small.by_left.keys() != big.by_left.keys()
    for left, places in small.by_left.items():
        if several:
            for p in places:
                for o in big.others(p, left, reach):
                    start, period = (p, o - p) if p < o else (o, p - o)
                    if period + depth >= min_length:
                        key = start, period + depth
                        found[key] = min(found.get(key, period), period)
    for left, places in small.by_left.items():
        mine = big.by_left.setdefault(left, [])
        for p in places:
            insort(mine, p)
            insort(big.all, p)
    return big


def word_runs(codes: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text of word numbers, by start, then period: maximal
    stretches with smallest period q of max(min_length, min_exponent * q) words at least
    (min_exponent 2 or more)."""
    n, least = len(codes), least_depth(min_length, min_exponent)
    if n <= least:
        return []
    order, lcp = suffix_array(codes)
    left = np.concatenate(([-1], codes))[order]  # nothing precedes the first word
    bounds = np.flatnonzero(lcp < least)
    ends = np.append(bounds[1:], n)
    diverse = np.concatenate(([0, 0], np.cumsum(left[1:] != left[:-1])))
    found: dict[tuple[int, int], int] = {}
    for lo, hi in zip(bounds.tolist(), ends.tolist()):
        if hi - lo < 2 or diverse[hi] == diverse[lo + 1]:
            continue
        at, depths, lefts = order[lo:hi].tolist(), lcp[lo:hi].tolist(), left[lo:hi].tolist()
        stack: list[list] = []  # open intervals: depth and what their children so far hold
        node = _Node(at[0], lefts[0])
        for k in range(1, hi - lo):
            depth = depths[k]
            while stack and stack[-1][0] > depth:
                d, other = stack.pop()
                node = _merge(other, node, d, min_length, min_exponent, found)
            if stack and stack[-1][0] == depth:
                stack[-1][1] = _merge(stack[-1][1], node, depth, min_length, min_exponent, found)
            else:
                stack.append([depth, node])
            node = _Node(at[k], lefts[k])
        while stack:
            d, other = stack.pop()
            node = _merge(other, node, d, min_length, min_exponent, found)
    # a stretch is found under every multiple of its smallest period that fits; the smallest was kept
    return sorted((s, length, q) for (s, length), q in found.items())


def _may_repeat(codes: np.ndarray, text: np.ndarray, n_texts: int, least: int) -> np.ndarray:
    """Which texts hold a window of ``least`` words twice, under different left words (hashes: rarely one
    text too many, never one too few)."""
    out = np.zeros(n_texts, bool)
    if len(codes) < least:
        return out
    whole = text[:len(text) - least + 1] == text[least - 1:]
    own = text.astype(np.uint64) << np.uint64(32)
    key = window_hashes(mix64(codes.astype(np.uint64) + own), least)[whole]
    left = np.where(np.concatenate(([True], text[1:] != text[:-1])), -1, np.concatenate(([-1], codes[:-1])))
    left, text = left[:len(whole)][whole], text[:len(whole)][whole]
    order = np.argsort(key)
    key, left = key[order], left[order]
    hit = (key[1:] == key[:-1]) & (left[1:] != left[:-1])
    out[text[order[1:][hit]]] = True
    return out


def _best(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run with the greatest length / period; of equal ones the first by start, then period."""
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top and dict(zip(("start", "length", "period"), top))


def runs_of_texts(texts: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[list, dict | None, bytes]]:
    """Runs, best run and collapsed text of every text."""
    words = [t.split() for t in texts]  # at x20 and x09-x0D
    flat = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(ws) for ws in words])
    text = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    look = _may_repeat(codes, text, len(texts), least_depth(min_length, min_exponent))
    out = []
    for k, ws in enumerate(words):
        runs = word_runs(codes[ends[k] - len(ws):ends[k]], min_length, min_exponent) if look[k] else []
        if runs:
            gone = np.zeros(len(ws) + 1, np.int64)
            for start, length, period in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            ws = [w for w, g in zip(ws, np.cumsum(gone).tolist()) if not g]
        out.append((runs, _best(runs), b" ".join(ws)))
    return out


def with_runs(docs: DataFrame, name: str = "repeats", min_length: int = 6, min_exponent: int = 4,
              text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``name`` (RUNS_TYPE): the runs of each text's words by start, then
    period; the one with the greatest exponent (null: no run); and ``collapsed``, the words that no run
    repeats after its first period, joined by one space.

    Words lie between x20 and x09-x0D.  A null or empty text has no words, no runs and an empty collapsed
    text (``text`` itself stays as it is); repeated rows and repeated or null ids stay as they are;
    other columns are untouched whatever their names; an empty table gives an empty one.  No
    shuffle: a task holds a slice of an Arrow batch, or one text and its suffix array.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")

    def make():
        def compute(texts):
            found = runs_of_texts(texts, min_length, min_exponent)
            triple = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
            runs = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs, _, _ in found]
            return pa.StructArray.from_arrays(
                [pa.array(runs, pa.list_(pa.struct(triple))), pa.array([b for _, b, _ in found], pa.struct(triple)),
                 pa.array([c.decode() for _, _, c in found], pa.string())], ["runs", "best", "collapsed"])
        return compute

    return with_text_column(docs, text_col, name, RUNS_TYPE, make)


# ---------------------------------------------------------------- the query

def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of every tenth document (crc32 of its id) from some word on replaced by
    repeats of the first of them; other texts as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns(
        {"n": F.size("words"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    one = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.expr("cast((n - a) div p + 1 as int)")
    made = F.concat(F.slice("words", 1, F.col("a")),
                    F.slice(F.flatten(F.array_repeat(one, times)), 1, F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(runs: Column) -> Column:
    """Lower-case hex SHA-256 of every run's ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(planted(documents(spark, sf_dir)))
    best = F.col("repeats.best")
    return found.select(
        "doc_id", F.size("repeats.runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * repeats.best.length div repeats.best.period").alias("exponent_milli"),
        run_digest(F.col("repeats.runs")).alias("runs_sha256"),
        F.sha2(F.col("repeats.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
