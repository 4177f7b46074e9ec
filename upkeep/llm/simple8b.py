"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A word has 64 bits: a selector in the low 4 and payload in the high 60.  Selector s >= 1 packs
``COUNTS[s]`` values of ``WIDTHS[s]`` bits, the first lowest (selector 1: values all zero).
Selector 0 is the escape: its payload is an index into a list of raw 64-bit values, so any
unsigned 64-bit integer can be stored.  Values are coded in blocks of BLOCK values that
start on a word of their own; the file keeps the first word of every block, so all blocks are
decoded at once, or any one alone.

Bytes, all little-endian: magic ``S8B1``, then five unsigned 64-bit counts (values, blocks,
words, escapes, BLOCK), the first word of every block (u64), the words, the escaped values.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8B1"
BLOCK = 1024
#: Values in a word of each selector; their width follows from the 60 bits of payload.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, *(60 // n for n in COUNTS[2:])])
_SMALL_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value; past 2**53 rounding may say one more, which then takes the escape."""
    if values.max(initial=0) < 1 << 16:
        return _SMALL_BITS[values.astype(np.uint16)]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """Selector of the word that would start at each value: the one that packs most.
    ``values`` is (blocks, BLOCK); a block's end counts as zeros."""
    n, width = values.shape
    best = np.zeros((n, width), np.int8)  # the escape, where nothing else fits
    # widest[:, i]: most bits among the next so many values, for growing numbers of values
    widest, so_many = np.zeros((n, width + int(COUNTS.max())), np.uint8), 1
    widest[:, :width] = _bits(values)
    for s in range(len(COUNTS) - 1, 0, -1):  # later, larger counts overwrite
        while so_many < COUNTS[s]:
            step = min(so_many, int(COUNTS[s]) - so_many)
            np.maximum(widest[:, :-step], widest[:, step:], out=widest[:, :-step])
            so_many += step
        np.copyto(best, s, where=widest[:, :width] <= WIDTHS[s])
    return best


def encode(values: np.ndarray) -> bytes:
    """File bytes of a one-dimensional array of unsigned integers."""
    values = np.ascontiguousarray(values, np.uint64)
    total = len(values)
    blocks = -(-total // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.ravel()[:total] = values
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = total - (blocks - 1) * BLOCK
    best = _selectors(grid)
    # walk all blocks from word to word together
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    starts = []
    while len(live):
        place = np.full(blocks, -1)
        place[live] = at[live]
        starts.append(place)
        at[live] += COUNTS[best[live, at[live]]]
        live = live[at[live] < length[live]]
    place = np.stack(starts, axis=1) if starts else np.empty((0, 0), np.int64)
    row = np.repeat(np.arange(blocks), (place >= 0).sum(axis=1))
    col = place[place >= 0]
    selector = best[row, col].astype(np.int64)
    words = selector.astype(np.uint64)
    # a word at a block's end packs zeros, never the next block's values
    padded = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.uint64)
    padded[:, :BLOCK] = grid
    flat, start = padded.ravel(), row * padded.shape[1] + col
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            raw = flat[start[here]]
            words[here] |= np.arange(len(here), dtype=np.uint64) << np.uint64(4)
            continue
        if WIDTHS[s]:
            packed = np.zeros(len(here), np.uint64)
            for j in range(COUNTS[s]):
                packed |= flat[start[here] + j] << np.uint64(4 + j * WIDTHS[s])
            words[here] |= packed
    escapes = raw if len(selector) and (selector == 0).any() else np.empty(0, np.uint64)
    first = np.searchsorted(row, np.arange(blocks)).astype("<u8")
    head = np.array([total, blocks, len(words), len(escapes), BLOCK], "<u8")
    return b"".join([MAGIC, head.tobytes(), first.tobytes(), words.astype("<u8").tobytes(),
                     escapes.astype("<u8").tobytes()])


def decode(data: bytes, block: int | None = None) -> np.ndarray:
    """The values of a file, or of one of its blocks, as unsigned 64-bit integers."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    total, blocks, n_words, n_escapes, size = np.frombuffer(data, "<u8", 5, 4).tolist()
    at = 44
    first = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * blocks)
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * (blocks + n_words))
    base, stop = 0, total
    if block is not None:
        last = int(first[block + 1]) if block + 1 < blocks else n_words
        words, base = words[int(first[block]):last], block * size
        stop, first = min(total, base + size), np.zeros(1, np.int64)
    out = np.zeros(stop - base + int(COUNTS.max()), np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[selector]
    ends = np.cumsum(count)
    starts = ends - count
    # a block's last word may be wider than what is left of the block
    block_of = np.searchsorted(first, np.arange(len(words)), "right") - 1
    start = block_of * size + starts - starts[first][block_of] if len(words) else starts
    limit = np.minimum((block_of + 1) * size, stop - base)
    payload = words >> np.uint64(4)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[start[here]] = escapes[payload[here].astype(np.int64)]
        elif WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                to = start[here] + j
                inside = to < limit[here]
                out[to[inside]] = (payload[here][inside] >> np.uint64(j * WIDTHS[s])) & mask
    return out[:stop - base]
