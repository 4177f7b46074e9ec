"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (token bytes, rank) becomes a ``tokenizers`` BPE model: token bytes are written
as characters by the byte-to-character mapping, and every split of a token into two other
tokens is a merge of that token's priority.  Text is cut into pieces at spaces that follow a
non-blank character - the splitting pattern always starts a new match there, so pieces encode
independently - and the ids of frequent pieces are kept in a bounded per-worker store.

Decoding reverses the byte table: ids map to token bytes, whose concatenation is the text's
UTF-8.  A character whose bytes are spread over several tokens is attributed to the token
that completes it (``token_texts``); character offsets count such a token from the start of
its first character (``token_offsets``).
"""

from __future__ import annotations

import base64
import codecs
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, ship_package, text_slices

#: Pieces and single matches kept per generation of a worker's stores, and the longest kept.
STORE_PIECES, STORE_MATCHES, STORE_CHARS = 100_000, 200_000, 64
_AFTER_WORD = re.compile(r"(?<=\S) ")
_BLANK_THEN_SPACE = re.compile(r"\s ")
#: A word of Latin letters and marks of ASCII after it: two matches of the usual patterns, which
#: take a run of letters, then a run of other marks.  (An apostrophe may start a contraction.)
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


class PieceStore(dict):
    """piece -> ids; a missing piece is computed.  Holds two generations of at most ``limit``
    pieces: when the young one is full it becomes the old one, so frequent pieces stay."""

    def __init__(self, compute, limit: int, longest: int = STORE_CHARS):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def byte_characters() -> str:
    """The 256 characters that stand for the bytes: printable Latin-1 characters stand for
    themselves, the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in set(shown) else chr(next(rest)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        chars = byte_characters()
        self.table = {i: c for i, c in enumerate(chars)}
        written = {t: t.decode("latin-1").translate(self.table) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token))]
            merges += [(written[a], written[b]) for a, b in
                       sorted((s for s in splits if s[0] in ranks and s[1] in ranks),
                              key=lambda s: (ranks[s[0]], ranks[s[1]]))]
        self.model = tokenizers.models.BPE({written[t]: r for t, r in ranks.items()}, merges,
                                           cache_capacity=0, ignore_merges=True)
        self.split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated")
        # what decoding reads: the byte table taken backwards
        back = {c: i for i, c in enumerate(chars)}
        size = max(ranks.values(), default=-1) + 1
        self.token_bytes = [b""] * size
        for t, r in ranks.items():
            self.token_bytes[r] = bytes(back[c] for c in written[t])
        self.token_length = np.array([len(t) for t in self.token_bytes], np.int64)
        self.matches = PieceStore(self._match_ids, STORE_MATCHES)
        self.written_id = [int(i).to_bytes(4, "little") for i in range(size)]
        self.pieces = PieceStore(lambda piece: self._piece_ids(" " + piece), STORE_PIECES)
        # whether the pattern cuts plain words as _PLAIN does
        self.plain = [m for m, _ in self.split.pre_tokenize_str(" Ab\u00e9.,% x")] == [
            " Ab\u00e9", ".,%", " x"]

    def _match_ids(self, match: str) -> bytes:
        written = match.encode().decode("latin-1").translate(self.table)
        written_id = self.written_id
        return b"".join([written_id[t.id] for t in self.model.tokenize(written)])

    def _piece_ids(self, piece: str) -> bytes:
        plain = self.plain and _PLAIN.fullmatch(piece, 1)
        if plain and piece[0] == " ":
            marks = plain[2]
            ids = self.matches[" " + plain[1]]
            return ids + self.matches[marks] if marks else ids
        return b"".join([self.matches[m] for m, _ in self.split.pre_tokenize_str(piece)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cut = _AFTER_WORD.split(text) if _BLANK_THEN_SPACE.search(text) else text.split(" ")
        if cut[0] == "" and len(cut) > 1:  # a text that starts with a space
            cut = _AFTER_WORD.split(text)
        pieces = self.pieces
        return b"".join([self._piece_ids(cut[0]), *[pieces[p] for p in cut[1:]]])

    def decode(self, ids: bytes) -> bytes:
        token = self.token_bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def token_texts(self, ids: bytes) -> list[str]:
        """Text of every token; bytes of an unfinished character wait for the token that
        completes it, bytes that never make a character become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.token_bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        rest = reader.decode(b"", True)
        if rest and out:
            out[-1] += rest
        return out

    def token_offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end (exclusive) code point of every token in its text."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        ends = np.cumsum(self.token_length[np.frombuffer(ids, "<u4")])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        inside = np.zeros(len(starts), np.int64)
        if len(starts):
            inside = (data[starts] & 0xC0) == 0x80
        return begun[starts] - inside, begun[ends]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", decoded: bool = False,
                     offsets: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian
    unsigned 32-bit) and, if asked for, ``decoded`` (binary: the bytes that the ids decode to)
    and ``starts``/``ends`` (code point offsets of every token) with ``n_split`` (tokens that begin
    inside a character whose first bytes an earlier token holds).

    A null text counts as empty; an empty text has no ids; repeated rows and repeated or null
    ids stay as they are; other columns are ignored whatever their names.  No shuffle: memory
    is bounded by a slice of an Arrow batch (or one text) and the worker's piece store.
    """
    ship_package(docs.sparkSession)
    keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary"
    schema += ", decoded binary" * decoded + ", starts array<int>, ends array<int>, n_split long" * offsets

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                if offsets:
                    spans = [bpe.token_offsets(x) for x in ids]
                    every = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in spans])]).astype(np.int32))
                    for k, name in enumerate(("starts", "ends")):
                        flat = np.concatenate([s[k] for s in spans]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(every, pa.array(flat)))
                        names.append(name)
                    # a token begins inside a character if it starts before the one ahead of it ends
                    cols.append(pa.array([int((a[1:] < b[:-1]).sum()) for a, b in spans], pa.int64()))
                    names.append("n_split")
                yield pa.RecordBatch.from_arrays(cols, names)

    return keep.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Digests of ids and decoded bytes; where there are offsets, also a hash of them and ``n_split``."""
    more = []
    if "starts" in encoded.columns:
        more = [F.xxhash64("starts", "ends").alias("offsets_xxhash64"), F.col("n_split")]
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digest(encode_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, decoded=True, offsets=True))
