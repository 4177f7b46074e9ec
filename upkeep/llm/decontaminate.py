"""Benchmark decontamination by SimHash windows.

Every benchmark item is looked for in windows of its own number of words.  A window can only
resemble an item if the two share a word shingle, so the shingles of the texts are first held
against those of the items, and all item-sized windows around a shared one are examined:
their SimHash fingerprints (over words) meet those of the items of the same length in a
multi-index - radius + 1 blocks of bits, of which at least one is equal for any two fingerprints
within the radius - and every candidate is verified by the exact weighted-shingle similarity
(sum of the smaller over sum of the larger counts).

Words are runs of letters, digits and non-ASCII characters, A-Z folded; shingles are five words,
or all words of a shorter item.  Texts are scanned once per block of items; a block's index is
bounded and goes to the tasks, a text never leaves its row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, fresh, window_hashes, with_text_column, word_hashes

#: Words per shingle, least similarity, and the radius: fingerprints of windows of 0.8 similarity
#: differ in about 4 (long items) to 10 (items of 8 words) bits.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 16
#: UTF-8 bytes of items in one block, the bound on what is sent to the tasks at a time.
BLOCK_BYTES = 8 << 20
LEAK = "array<struct<item_id:bigint,similarity:double,distance:int,start:bigint,end:bigint>>"


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingle hashes, weights being counts."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return shared / (len(a) + len(b) - shared)


def simhashes(words: np.ndarray) -> np.ndarray:
    """Fingerprints of an array (windows, words) of word hashes: a bit is 1 if set in over half."""
    out = []
    step = max(1, (1 << 22) // max(1, 64 * words.shape[1]))
    for lo in range(0, len(words), step):
        part = np.ascontiguousarray(words[lo:lo + step])
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        ones = bits.reshape(len(part), -1, 64).sum(axis=1, dtype=np.int32)
        out.append(np.packbits(ones * 2 > words.shape[1], axis=1, bitorder="little").view("<u8")[:, 0])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class ItemIndex:
    """Shingles and fingerprints of a block of benchmark items (ids, UTF-8 texts)."""

    def __init__(self, ids: list[int], texts: list[bytes], radius: int = RADIUS, k: int = SHINGLE,
                 least: float = SIMILARITY):
        self.radius, self.k, self.least = radius, k, least
        self.ids, self.words, self.shingles = [], [], []
        for i, t in zip(ids, texts):
            w = word_hashes(t, punctuation=True)[0]
            if len(w):
                self.ids.append(i)
                self.words.append(w)
                self.shingles.append(window_hashes(w, min(k, len(w))))
        size = np.array([len(w) for w in self.words], np.int64)
        # (shingle, length of the item) for every shingle size in use
        self.by_size = {}
        for s in np.unique(np.minimum(size, k)).tolist():
            items = np.flatnonzero(np.minimum(size, k) == s)
            hashes = np.concatenate([self.shingles[i] for i in items])
            lengths = np.repeat(size[items], [len(self.shingles[i]) for i in items])
            pairs = np.unique(np.rec.fromarrays([hashes, lengths], names="h,n"))
            seen = np.zeros(1 << 20, bool)
            seen[(pairs.h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[s] = np.ascontiguousarray(pairs.h), np.ascontiguousarray(pairs.n), seen
        # the multi-index: per item length, each block of bits in sorted order
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.by_length = {}
        for n in np.unique(size).tolist():
            items = np.flatnonzero(size == n)
            fp = simhashes(np.stack([self.words[i] for i in items]))
            sorted_blocks = []
            for shift, mask in self.blocks:
                value = (fp >> shift) & mask
                order = np.argsort(value, kind="stable")
                sorted_blocks.append((value[order], order))
            self.by_length[n] = items, fp, sorted_blocks

    def windows(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, the starts of all windows that share a shingle with an item of that
        length.  ``first`` and ``last``: bounds of the text that each word belongs to."""
        found: dict[int, list] = {}
        for s, (hashes, lengths, seen) in self.by_size.items():
            got = window_hashes(words, s)
            at = np.flatnonzero(seen[(got & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[at + s <= last[at]]
            lo = np.searchsorted(hashes, got[at], "left")
            hi = np.searchsorted(hashes, got[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            at, entry = np.repeat(at, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for length in np.unique(lengths[entry]).tolist():
                here = at[lengths[entry] == length]
                # a text shorter than the item is one window by itself
                low = np.maximum(first[here], here + s - length)
                high = np.maximum(low, np.minimum(here, last[here] - length))
                spans = np.unique(np.stack([low, high]), axis=1)
                count = spans[1] - spans[0] + 1
                starts = np.repeat(spans[0] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                found.setdefault(length, []).append(np.unique(starts))
        return {n: np.unique(np.concatenate(x)) for n, x in found.items()}

    def candidates(self, fp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius."""
        items, own, sorted_blocks = self.by_length[length]
        pairs = []
        for (shift, mask), (values, order) in zip(self.blocks, sorted_blocks):
            mine = (fp >> shift) & mask
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(fp)), n)
            entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = order[entry]
            near = np.bitwise_count(fp[window] ^ own[item]) <= self.radius
            pairs.append(window[near] * len(items) + item[near])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(items), pair % len(items)
        return window, items[item], np.bitwise_count(fp[window] ^ own[item]).astype(np.int32)

    def leaks(self, texts: list[bytes]) -> list[list[dict]]:
        """Per text, the best window (then the earliest) of every item found in it."""
        out: list[list[dict]] = [[] for _ in texts]
        words, starts, ends = word_hashes(b"\n".join(texts), punctuation=True)
        offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
        doc = np.searchsorted(offset, starts, "right") - 1
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        first, last = bounds[doc], bounds[doc + 1] if len(doc) else doc
        best: dict[tuple[int, int], tuple] = {}
        for length, at in self.windows(words, first, last).items():
            at = at.astype(np.int64)
            stop = np.minimum(at + length, last[at])
            # windows of a text shorter than the item have fewer words; take them one by one
            whole = stop - at == length
            fp = np.zeros(len(at), np.uint64)
            fp[whole] = simhashes(words[at[whole][:, None] + np.arange(length)])
            for i in np.flatnonzero(~whole):
                fp[i] = simhashes(words[at[i]:stop[i]][None, :])[0]
            for w, item, distance in zip(*(x.tolist() for x in self.candidates(fp, length))):
                a, b = int(at[w]), int(stop[w])
                k = min(self.k, length)
                if b - a < k:
                    continue
                score = similarity(window_hashes(words[a:b], k), self.shingles[item])
                if score >= self.least:
                    key = int(doc[a]), item
                    if key not in best or (-score, a) < best[key][:2]:
                        best[key] = -score, a, b, distance
        for (d, item), (score, a, b, distance) in sorted(best.items()):
            base, text = int(offset[d]), texts[d]
            start = len(text[:int(starts[a]) - base].decode())
            end = start + len(text[int(starts[a]) - base:int(ends[b - 1]) - base].decode())
            out[d].append({"item_id": self.ids[item], "similarity": -score, "distance": distance,
                           "start": start, "end": end})
        return out


def item_blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items, a bounded block at a time, as (ids, texts); blocks are dealt by hash."""
    items = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        "text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = sorted(mine.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield [r[0] for r in rows], [r[1].encode() for r in rows]


def with_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", name: str = "leaks",
               item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS,
               k: int = SHINGLE, least: float = SIMILARITY,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one more column, an array (LEAK) of the items found in each text: the best
    window's similarity, fingerprint distance, and first and end code point.  The column is called
    ``name``, with underscores added if taken.

    Null and empty texts, and items without words, give no leak; repeated rows get equal results;
    repeated items are reported each; among equally similar windows the earliest counts; other
    columns pass through untouched.  An empty benchmark gives empty arrays.
    """
    name = fresh(docs.columns, name)
    out = docs.withColumn(name, F.array().cast(LEAK))
    sc = docs.sparkSession.sparkContext
    for ids, texts in item_blocks(bench, item_id, item_text, block_bytes):
        sent = sc.broadcast((ids, texts))

        def make(sent=sent):
            index = ItemIndex(*sent.value, radius, k, least)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()),
                                       ("distance", pa.int32()), ("start", pa.int64()),
                                       ("end", pa.int64())]))
            return lambda texts: pa.array(index.leaks(texts), kind)

        more = fresh(out.columns, "more")
        out = with_text_column(out, text_col, more, LEAK, make)
        out = out.withColumn(name, F.concat(name, more)).drop(more)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaked item and document; clean documents have none."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = with_leaks(documents(spark, sf_dir).select("doc_id", "text"), bench)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
