"""WARC archives: records written as whole-file gzip streams, normalised to one gzip member a record
with a sidecar offset index, and read back through that index.

Spark's text writer makes the monolithic archives (a record is one value, the line separator is the
last line end of a record), so its commit protocol and file systems apply.  The normaliser lets
Spark's text reader inflate each stream once, front to back; a task holds one Arrow batch of lines or one
record, never a file.  Its output files carry the task attempt in their name and count only if
the index, a Parquet table that Spark commits, names them: what a lost executor left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import ship_package
from upkeep.session import Scratch

CRLF = "\r\n"
#: A payload that more than one in so many of all copies share is hot (so there are fewer such payloads).
HOT_SHARE = 256
#: Adjoining members read at once, in bytes (a longer one is read alone).
READ_BYTES = 4 << 20
# WARC 1.1 profile of a revisit, digits of hex-like base 32 and of RFC 4648 base 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_COUNT, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX_SCHEMA = ("archive string, record long, offset long, length long, source string, type string, "
                "record_id string, target_uri string, payload_digest string, refers_to string")
RECORD_SCHEMA = ("record_id string, type string, target_uri string, refers_to string, payload_bytes long, "
                 "payload_digest string, intact boolean")


# ---------------------------------------------------------------- records

def base32_sha1(sha_hex: Column) -> Column:
    """RFC 4648 base 32 of a SHA-1 given in hex: five hex digits are four base-32 digits."""
    fours = [F.lpad(F.conv(F.substring(sha_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), BASE32_COUNT, BASE32)


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                 scratch: Scratch | None = None) -> DataFrame:
    """One column ``record``: the text of a WARC record per row of ``pages``, but for its last line end.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id becomes a
    response, the others revisits of it, which hold the HTTP header only; rows that repeat that id
    are responses too.  A null payload is an empty one; a null id is smaller than any (and its record is
    called ``<urn:page:null>``; rows of a payload without any id are responses); a null URL becomes
    the record's name; control characters and blanks in URLs are percent-encoded; other columns
    are ignored whatever their names; an empty table gives no record.

    Payloads are told apart by SHA-1 and length.  They are not shuffled while the table of shared payloads
    is small enough to broadcast by its written size; beyond, the join spreads rows of hot
    payloads (fewer than HOT_SHARE, which are broadcast) by id.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                         F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
            .withColumns({"sha": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")}))
    shared = scratch.write(rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes")
                           .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copies = shared.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > copies
    hot = shared.filter(is_hot).select("sha", "bytes", F.struct("top").alias("hot"))
    cold = shared.filter(~is_hot).select(F.col("sha").alias("key"), F.col("bytes").alias("cold_bytes"),
                                         F.struct("top").alias("cold"))
    spread = F.concat(F.lit("hot "), F.xxhash64("id", "url").cast("string"))
    met = rows.join(F.broadcast(hot), ["sha", "bytes"], "left").withColumn(
        "key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(spread))
    met = met.join(cold, (met["key"] == cold["key"]) & (met["bytes"] == cold["cold_bytes"]), "left")
    top = F.coalesce("hot", "cold")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    met = met.withColumns({"top": top, "digest": base32_sha1(F.col("sha"))}).withColumn(
        "revisit", F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top.top")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    size = F.octet_length("http") + F.octet_length("body")
    uri = F.col("url")
    for code in [*range(0x21), 0x7F]:
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), uri).otherwise(F.col("url")),
                                                        name(F.col("id")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("top.top")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), size.cast("string")))
    return met.withColumns({"http": http, "body": body}).select(
        F.concat(header, F.lit(CRLF * 2), F.col("http"), F.col("body"), F.lit(CRLF)).alias("record"))


def write_monolithic(records: DataFrame, path: str, level: str = "BEST_SPEED") -> None:
    """Write the column ``record`` as archives of one gzip stream each, a file per partition."""
    records.select("record").write.option("compression", "gzip").option("lineSep", CRLF).option(
        "zlib.compress.level", level).text(path)


# ---------------------------------------------------------------- the normaliser

_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*\r?$", re.IGNORECASE | re.MULTILINE)
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.MULTILINE)


class RecordCutter:
    """Cuts an inflated WARC stream, fed in pieces of any size, into whole records."""

    def __init__(self, name: str):
        self.name, self.held, self.need, self.done = name, bytearray(), 1, 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        held, at = self.held, 0
        held += piece
        while len(held) - at >= self.need:
            while held.startswith(b"\r\n", at):
                at += 2
            head = held.find(b"\r\n\r\n", at)
            if not held.startswith(b"WARC/"[:len(held) - at], at):
                raise ValueError(f"{self.name}: no WARC record at byte {self.done + at} of the stream")
            if head < 0:
                self.need = max(1, 2 * (len(held) - at))
                break
            length = _LENGTH.search(held, at, head)
            if length is None:
                raise ValueError(f"{self.name}: no Content-Length in the record at byte {self.done + at}")
            end = head + 4 + int(length[1]) + 4
            if end > len(held):
                self.need = end - at
                break
            yield bytes(held[at:end])
            at, self.need = end, 1
        del held[:at]
        self.done += at

    def close(self) -> Iterator[bytes]:
        self.need = 1
        yield from self.feed(b"")
        if self.held.strip(b"\r\n"):
            raise ValueError(f"{self.name}: the stream ends within a record")


def record_fields(record: bytes) -> dict[str, str]:
    """The named fields of a record's header, by lower-case name."""
    head = record[:record.index(b"\r\n\r\n")]
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and folder of a Hadoop-style path."""
    for written, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if path.startswith(written):
            path = plain + path[len(written):]
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class MemberWriter:
    """An archive with one gzip member per record, and the index rows of its records."""

    def __init__(self, folder: str, source: str, level: int):
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        stem = source.split(".")[0]
        self.name = f"{stem}-{TaskContext.get().taskAttemptId()}.warc.gz"
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.source, self.level, self.offset, self.rows = source, level, 0, []
        self.number = 0

    def add(self, record: bytes) -> None:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.flush()
        self.out.write(member)
        f = record_fields(record)
        self.rows.append((self.name, self.number, self.offset, len(member), self.source, f.get("warc-type"),
                          f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"),
                          f.get("warc-refers-to")))
        self.offset += len(member)
        self.number += 1

    def index(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        types = [pa.int64() if f.endswith(" long") else pa.string() for f in INDEX_SCHEMA.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def normalise(spark: SparkSession, source: str, path: str, level: int = 1) -> DataFrame:
    """Rewrite the monolithic archives under ``source`` (gzip streams of WARC records whose lines end in
    CR LF) to ``path``: ``archives/`` holds one file per stream with every record as its own gzip
    member, ``index/`` (a Parquet table, returned) a row per record with its file, offset and length.

    A stream is inflated once, by the task that rewrites it.  A stream that ends within a record, or
    holds something other than records, fails the job by name.  A stream without records leaves no file.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", CRLF).text(source).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_name").alias("source"))
    folder = f"{path}/archives"

    def run(batches):
        cutter = writer = None

        def end():
            nonlocal cutter, writer
            for record in cutter.close():
                writer = writer or MemberWriter(folder, cutter.name, level)
                writer.add(record)
            if writer is not None:
                writer.out.close()
                yield writer.index()
            cutter = writer = None

        for batch in batches:
            files, values = batch.column("source").to_pylist(), batch.column("line").to_pylist()
            lo = 0
            while lo < len(files):
                hi = lo + 1 if files[-1] != files[lo] else len(files)
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if cutter is not None and cutter.name != files[lo]:
                    yield from end()
                if cutter is None:
                    cutter = RecordCutter(files[lo])
                for record in cutter.feed(b"\r\n".join(values[lo:hi]) + b"\r\n"):
                    writer = writer or MemberWriter(folder, files[lo], level)
                    writer.add(record)
                lo = hi
            if writer is not None and writer.rows:
                yield writer.index()
        if cutter is not None:
            yield from end()

    lines.mapInArrow(run, INDEX_SCHEMA).write.mode("errorifexists").parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index of the archives at ``path``."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


# ---------------------------------------------------------------- reading

def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of adjoining members of one archive, READ_BYTES long at most unless a single one is longer."""
    run: list[dict] = []
    for row in rows:
        if run and (row["archive"] != run[-1]["archive"] or row["offset"] != run[-1]["offset"] + run[-1]["length"]
                    or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _http_payload(block: bytes) -> tuple[bytes, int | None]:
    """Body of an HTTP message and the length that its header states."""
    head = block.find(b"\r\n\r\n")
    if head < 0:
        return block, None
    length = _LENGTH.search(block, 0, head)
    return block[head + 4:], int(length[1]) if length else None


def read_records(index: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records that the rows of ``index`` (all, or those that a filter leaves) point to, in the
    archives at ``path``: RECORD_SCHEMA and, if asked for, ``payload`` (binary; null for revisits).

    Length and digest (bare base-32 SHA-1) of responses come from the payload itself; ``intact`` says
    whether they agree with the header.  Those of revisits come from their header.
    """
    ship_package(index.sparkSession)
    schema = RECORD_SCHEMA + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]]
             for f in schema.split(", ")]
    folder = f"{path}/archives"

    def read(record: bytes) -> tuple:
        f = record_fields(record)
        head = record.index(b"\r\n\r\n") + 4
        block = record[head:head + int(f["content-length"])]
        stated = f.get("warc-payload-digest", "").rpartition(":")[2] or None
        body, length = _http_payload(block) if "http" in f.get("content-type", "") else (block, None)
        if f["warc-type"] == "revisit":
            out, size, digest, intact = None, length, stated, None
        else:
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            out, size, intact = body, len(body), stated in (None, digest) and length in (None, len(body))
        row = (f.get("warc-record-id"), f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), size, digest, intact)
        return row + (out,) * payload

    def run(batches):
        store, root = open_folder(folder)
        name = file = None
        for batch in batches:
            for part in _ranges(batch.to_pylist()):
                if part[0]["archive"] != name:
                    if file is not None:
                        file.close()
                    name = part[0]["archive"]
                    file = store.open_input_file(f"{root}/{name}")
                first, last = part[0]["offset"], part[-1]
                data = file.read_at(last["offset"] + last["length"] - first, first)
                found = [read(zlib.decompress(data[r["offset"] - first:r["offset"] - first + r["length"]], 31)) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
        if file is not None:
            file.close()

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, **columns) -> DataFrame:
    """Write ``pages`` (see ``page_records``) as monolithic archives, normalise them to ``path`` and
    return the index.  The monolithic files are deleted once rewritten."""
    with Scratch(pages.sparkSession) as scratch:
        raw = scratch.new_path()
        write_monolithic(page_records(pages, min_bytes, scratch=scratch, **columns), raw)
        return normalise(pages.sparkSession, raw, path)


def page_id(record_id: str) -> Column:
    """The page that a record's name stands for (null: none)."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).new_path()
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(index, path).select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_id("refers_to").alias("refers_to"))
