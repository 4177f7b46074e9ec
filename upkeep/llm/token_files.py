"""Token ids of whole documents in Simple-8b files, ordered by document id.

Documents are range-partitioned and sorted by id, encoded with the ``tokenizers`` library and
written as segments: a row of a Parquet table (Spark's committed write, so lost executors
and retried tasks leave no half files) whose ``data`` is a self-contained Simple-8b file
(``simple8b``) with the ids of whole documents, next to the ids' owners and lengths.  ``part`` and
``segment`` number the segments in document order.  Reading needs no other state.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.llm import simple8b
from upkeep.llm.bpe import PieceStore, byte_characters
from upkeep.llm.common import documents, ship_package, text_key, text_slices
from upkeep.session import Scratch

#: Ids and documents after which a segment is closed, at the end of a slice of texts.  Packing takes about
#: 48 bytes an id, and every core of an executor packs a segment of its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 18, 1 << 16
#: Bytes of text whose words are numbered at once.
TEXT_BYTES = 1 << 19
#: Runs of letters, and other words or marks, kept per generation of a worker's stores.
STORE_LETTERS, STORE_OTHERS = 150_000, 50_000
SEGMENT_SCHEMA = ("part int, segment int, doc_ids array<long>, n_tokens array<long>, "
                  "n_ids long, data binary")
#: Letters below U+0250 are composed already and each have one lower-case letter, but for U+0130.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Marks that may follow a word's letters; a run of them is one match of the usual patterns.
_MARKS = ".,;:!?%$#&*|"


class WordBpe:
    """Ids of texts by a tokenizer file whose normaliser and splitter never look across blanks
    (composition, folding of blanks, lower case; matches without blanks), so that words encode
    independently and frequent ones are kept.  Added tokens of the file match as in the library's
    ``encode(text, add_special_tokens=False)``: words that hold one are encoded by the library as they
    are.  Other tokenizers encode whole texts."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # in the text as written, without blanks, never within letters and marks
        plain = all(t.content.isascii() and len(t.content.split()) == 1 and t.content == t.content.strip()
                    and not re.fullmatch(f"[A-Za-z{re.escape(_MARKS)}]+", t.content)
                    and not (t.normalized or t.single_word or t.lstrip or t.rstrip) for t in added)
        probe = "A b'sÉ́  c12,.-d\n e'll　Fg Å"
        # the parts of a probe must give what the whole gives; else words are not independent
        self.by_word = (plain and self._whole(probe) == b"".join(map(self._whole, probe.split(" ")))
                        and self._whole("ab,%c") == b"".join(map(self._whole, ("ab", ",%", "c")))
                        and self._whole("AB") == self._whole("ab"))
        chars = byte_characters()
        self.table = {i: c for i, c in enumerate(chars)}
        self.written_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = PieceStore(self._letter_ids, STORE_LETTERS)
        self.others = PieceStore(self._whole, STORE_OTHERS)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _letter_ids(self, letters: str) -> bytes:
        """Ids of composed lower-case letters: one match, written in the byte table's characters."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.table)
        ids = self.written_id
        return b"".join([ids[t.id] for t in self.tokenize(letters)])

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([data], pa.large_binary()).cast(pa.large_string()))[0].tobytes()

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has; a null text has none.

        Words are numbered, so each is looked at once however often the texts hold it.  One of Latin letters
        and marks after them is taken apart (letters, then marks, both numbered again); other words
        are encoded by the library as they are."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            found = [self._whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)
        words = pc.ascii_split_whitespace(texts)  # an empty word, where there is one, has no ids
        flat = words.flatten().dictionary_encode()
        plain = pc.match_substring_regex(flat.dictionary, f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$")
        simple = flat.dictionary.filter(plain)
        letters = pc.utf8_lower(pc.utf8_rtrim(simple, _MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(simple, f"^[{_LETTERS}]+", "").dictionary_encode()
        parts = [letters.dictionary, marks.dictionary, flat.dictionary.filter(pc.invert(plain))]
        stores = [self.letters, self.others, self.others]
        found = [store[x] for part, store in zip(parts, stores) for x in part.to_numpy(zero_copy_only=False)]
        found.append(b"")  # the marks of a word without any
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(length) - length
        # two parts of every distinct word, then of every word
        is_plain, base = plain.to_numpy(zero_copy_only=False), np.cumsum([0, *map(len, parts)])
        part = np.full((len(is_plain), 2), len(found) - 1)
        part[is_plain, 0] = letters.indices.to_numpy()
        part[is_plain, 1] = base[1] + marks.indices.to_numpy()
        part[~is_plain, 0] = np.arange(base[2], base[3])
        every = part[flat.indices.to_numpy()].ravel()
        n = length[every]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(first[every] - ends[:-1], n) + np.arange(ends[-1])
        cuts = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids[place], np.diff(ends[2 * cuts])


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_segments(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (SEGMENT_SCHEMA) of ``docs`` in ascending id order; see ``write_token_files``."""
    ship_package(docs.sparkSession)
    key = F.col("doc_id").asc_nulls_first(), F.col("key").asc()
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .withColumn("key", text_key(F.col("text")))
               .repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text"))

    def run(batches):
        words, part = load(tokenizer_path), TaskContext.get().partitionId()
        owners, lengths, ids, n, segment = [], [], [], 0, 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()),
                 pa.array([np.concatenate(owners)], pa.list_(pa.int64())),
                 pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([n], pa.int64()),
                 pa.array([simple8b.encode(np.concatenate(ids))], pa.binary())],
                ["part", "segment", "doc_ids", "n_tokens", "n_ids", "data"])

        for batch in batches:
            for piece in text_slices(batch, "text", TEXT_BYTES):
                found, length = words.encode_texts(piece.column("text"))
                if end_id is not None:
                    found, length = np.insert(found, np.cumsum(length), end_id), length + 1
                owners.append(np.array(piece.column("doc_id").to_pylist(), object))
                lengths.append(length)
                ids.append(found)
                n += len(found)
                if n >= SEGMENT_IDS or sum(map(len, owners)) >= SEGMENT_DOCS:
                    yield close()
                    owners, lengths, ids, n, segment = [], [], [], 0, segment + 1
        if owners:
            yield close()

    return ordered.mapInArrow(run, SEGMENT_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row of ``docs`` to ``path``, ascending by id.

    A null text counts as empty (it still gets ``end_id``); null ids come first; rows that
    share an id follow a hash of their text, equal rows are interchangeable; other columns
    are ignored whatever their names; an empty table writes no segment.  A hot id is split by
    the range partitioning too, because the text's hash is part of the order.  The one
    shuffle moves texts once; a task holds one segment.
    """
    encode_segments(docs, tokenizer_path, end_id, id_col, text_col).write.mode(
        "errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document of the files at ``path``: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` (array of long)."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    ship_package(spark)
    schema = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" * ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = simple8b.decode(row["data"]).astype("<u4")
                ends = np.cumsum(row["n_tokens"], dtype=np.int64)
                starts = ends - np.array(row["n_tokens"], np.int64)
                cut = [values[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(np.full(len(cut), row["part"], np.int32)),
                        pa.array(np.full(len(cut), row["segment"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts),
                        pa.array(row["n_tokens"], pa.int64()),
                        pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                if ids:
                    cols.append(pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    cols, ["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32",
                           "ids"][:len(cols)])

    # ids before each segment: one number per segment, summed within its part, then the parts
    # (one row per write task) in order
    part_ids = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = part_ids.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")
                                .rowsBetween(Window.unboundedPreceding, -1))
    starts = (segments.select("part", "segment", F.coalesce(inner, F.lit(0)).alias("seg_start"))
              .join(parts, "part")
              .select("part", "segment", (F.col("part_start") + F.col("seg_start")).alias("base")))
    out = segments.mapInArrow(run, schema).join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens",
                      "ids_crc32", *["ids"] * ids)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark).new_path()
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path, ids=False)
