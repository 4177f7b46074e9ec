"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is dropped if an earlier line of the corpus, in order of (document id, line number), is
equal to it or, for lines of at least ``near_chars`` characters, within one edit (insert, delete or
replace one character).  Blank lines are structure and stay.

1. Every line becomes a hash and a position; equal lines are reduced to their first position
   before anything else, so no group of copies is ever gathered.
2. A line can only have a neighbour if some other line equals it outside one window of about a
   quarter of its length, aligned from the left and from the right.  Hashes of the line without
   each of its four windows are counted; only lines that share one go on.  This loses nothing: one edit
   lies in some window.
   The same step inside the shared windows narrows them to a sixteenth of the line.
3. For those lines, all variants within the edit bound that touch the shared window are emitted
   as hashed keys: the line itself, the line with one character deleted, and the line with one
   character deleted and its place kept (the window's text together with the hash of the rest).  Lines meet over equal keys (deleted against whole: one
   insert or delete; deleted at the same place: one replaced character) and the edit distance
   to the earliest line under the key is verified.
4. The first position of every kept line returns to its document as a bit set of line numbers, by
   which the text is rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, fresh, text_key
from upkeep.session import Scratch

#: Windows of a line, the unit to which their lengths are rounded, and the shortest line
#: that is compared with an edit.
WINDOWS, UNIT, NEAR_CHARS = 4, 4, 20
#: Hash buckets of the semi-join reduction: at most so many small numbers are broadcast.
BUCKETS = 1 << 18
#: Line numbers per word of a document's bit set.
BITS = 62


def _unit(length: Column, step: int = UNIT) -> Column:
    """Length of the aligned pieces outside the windows of a text, a multiple of ``step``."""
    return F.floor(length / (WINDOWS * step)).cast("int") * step


def _outside(text: Column, length: Column, unit: Column, *more: Column) -> list[Column]:
    """Hash of ``more`` and the text without window j, for every j."""
    keys = []
    for j in range(WINDOWS):
        left, right = unit * j, unit * (WINDOWS - 1 - j)
        keys.append(F.xxhash64(F.lit(j), unit, *more, F.substring(text, F.lit(1), left),
                               F.substring(text, length - right + 1, right)))
    return keys


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose ``key`` occurs with more than one line: two extremes tell (different lines
    have different hashes), so no group is gathered."""
    keys = (keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
            .filter("lo != hi").select("key"))
    return keyed.join(keys, "key", "left_semi")


def _written(line: Column) -> Column:
    """Whether a line is more than x20 and x09-x0D."""
    return line.rlike(r"[^ \t-\r]")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line of (doc_id, tkey, text): its hash, number and text."""
    parts = docs.select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parts = parts.filter(_written(F.col("line")))
    return parts.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _position() -> Column:
    """One number that orders lines by document id (null last), text hash and line number."""
    past = F.lit(str(1 << 63)).cast("decimal(20,0)")
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), past)
    low = F.shiftrightunsigned("tkey", 32) * (1 << 31) + F.col("line_no")
    return (doc * past).cast("decimal(38,0)") + low.cast("decimal(38,0)")


def _near_firsts(docs: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier neighbour.  ``first`` holds every
    distinct line's position, length and window hashes (``keys``)."""
    keyed = first.filter(F.size("keys") > 0).select("h1", "h2", F.explode("keys").alias("key"))
    alive = scratch.write(_shared(keyed).select("h1", "h2", "key"))
    # texts of those lines: a bounded set of hash buckets first thins out the scan, then an exact join
    buckets = F.broadcast(alive.select(F.pmod("h1", F.lit(BUCKETS)).cast("int").alias("bucket")).distinct())
    texts = (_lines(docs).withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int"))
             .join(buckets, "bucket", "left_semi").select("h1", "h2", "line"))
    texts = texts.groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    texts = texts.join(first.select("h1", "h2", "pos"), ["h1", "h2"])
    n = F.length("line")
    live = alive.groupBy("h1", "h2").agg(F.collect_set("key").alias("alive"))  # at most 8 keys
    lines = scratch.write(texts.join(live, ["h1", "h2"]).withColumn("n", n))
    # the windows whose outside is shared, for either length class; then the same inside them, so
    # that variants are made of some sixteenth of a line and hashed with what lies around it
    units = [_unit(F.col("n")), _unit(F.col("n") - 1)]
    inner = F.array(*[F.struct(key.alias("key"), F.substring("line", unit * j + 1, F.col("n") - unit * (WINDOWS - 1))
                               .alias("text")) for unit in units
                      for j, key in enumerate(_outside(F.col("line"), F.col("n"), unit))])
    windows = lines.select("h1", "h2", "pos", "alive", F.explode(F.array_distinct(inner)).alias("w")).filter(
        F.array_contains("alive", F.col("w.key"))).select("h1", "h2", "pos", "w.*")
    m = F.length("text")
    parts = F.array(*[F.struct(key.alias("key"), F.substring("text", unit * j + 1, m - unit * (WINDOWS - 1))
                               .alias("text")) for unit in (_unit(m, 1), _unit(m - 1, 1))
                      for j, key in enumerate(_outside(F.col("text"), m, unit, F.col("key")))])
    close = _shared(windows.select("h1", "h2", "pos", F.explode(F.array_distinct(parts)).alias("w"))
                    .select("h1", "h2", "pos", "w.*"))
    cut = lambda i: F.concat(F.substring("text", F.lit(1), i), F.substring("text", i + 2, m))
    places = F.sequence(F.lit(0), m - 1)
    variants = F.concat(
        F.array(F.struct(F.lit("whole").alias("side"), F.lit("deleted").alias("meets"),
                         F.xxhash64("key", "text").alias("key"))),
        F.transform(places, lambda i: F.struct(F.lit("deleted").alias("side"), F.lit("whole").alias("meets"),
                                               F.xxhash64(F.col("key"), cut(i)).alias("key"))),
        F.transform(places, lambda i: F.struct(F.lit("replaced").alias("side"), F.lit("replaced").alias("meets"),
                                               F.xxhash64(F.col("key"), i, cut(i)).alias("key"))))
    emitted = scratch.write(close.filter(m > 0).select("h1", "h2", "pos", F.explode(F.array_distinct(variants)).alias("v"))
                            .select("h1", "h2", "pos", "v.*"))
    # keys met by one line only end here; the others are joined with the earliest under the key
    earliest = emitted.groupBy("key", "side").agg(F.min("pos").alias("epos"),
                                                  F.min_by("h1", "pos").alias("e1"),
                                                  F.min_by("h2", "pos").alias("e2"))
    meets = (emitted.join(earliest.select("key", F.col("side").alias("meets"), "epos", "e1", "e2"),
                          ["key", "meets"]).filter("epos < pos")
             .select("h1", "h2", "e1", "e2").distinct())
    mine = lines.select("h1", "h2", "line")
    theirs = lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("eline"))
    verified = meets.join(mine, ["h1", "h2"]).join(theirs, ["e1", "e2"]).filter(
        F.levenshtein("line", "eline", 1).between(0, 1))
    return verified.select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                name: str = "lines", near_chars: int = NEAR_CHARS,
                scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the dropped lines cut out of the text and one more column, a struct of
    ``n_lines`` (lines of the text, blank ones too), ``n_dropped`` and ``n_left`` (lines that are not
    blank and stay).  The column is called ``name``, with underscores added if taken.

    A null text stays null and counts as one blank line; an empty text likewise stays.  Documents
    with a null id come after all others.  Rows that share an id are ordered by a hash of their
    text; rows equal in id and text are the same document and keep the same lines.  Of lines
    with a common earliest neighbour only the edit bound to that neighbour counts, so a line is
    dropped for an earlier line that is itself dropped.  Other columns pass through untouched.
    Runs Spark jobs and writes to the checkpoint folder; a ``scratch`` of the caller's lets it delete
    those tables once the result is stored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    name = fresh(docs.columns, name)
    near_chars = max(near_chars, WINDOWS * UNIT + 1)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("tkey", text_key(F.col("text")))
    n = F.length("line")
    unit, shorter = _unit(n), _unit(n - 1)
    keys = F.when(n >= near_chars, F.concat(
        F.array(*_outside(F.col("line"), n, unit)),
        F.when(unit != shorter, F.array(*_outside(F.col("line"), n, shorter))).otherwise(F.array().cast("array<bigint>"))))
    flat = _lines(slim).select("h1", "h2", "doc_id", "tkey", "line_no", _position().alias("pos"),
                               keys.alias("keys"))
    slots = [f"k{i}" for i in range(2 * WINDOWS)]
    flat = flat.withColumns({c: F.get("keys", F.lit(i)) for i, c in enumerate(slots)})
    # equal lines have equal window hashes, so any row's will do; all buffers are plain numbers
    first = scratch.write(
        flat.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.min_by("doc_id", "pos").alias("doc_id"),
                                     F.min_by("tkey", "pos").alias("tkey"),
                                     F.min_by("line_no", "pos").alias("line_no"),
                                     *[F.max(c).alias(c) for c in slots])
        .withColumn("keys", F.array_compact(F.array(*slots))).drop(*slots))
    near = _near_firsts(slim, first, scratch)
    kept = first.join(near, ["h1", "h2"], "left_anti")
    words = (kept.groupBy("doc_id", "tkey", F.floor(F.col("line_no") / BITS).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                           F.col("line_no") % BITS)).alias("bits")))
    sets = words.groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__kept"))
    # back to the documents, under names that cannot clash
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): p for c, p in zip(docs.columns, plain)}
    own = docs.toDF(*plain)
    text, ident = F.col(at[text_col.lower()]), F.col(at[id_col.lower()]).cast("long")
    own = own.withColumns({"__tkey": text_key(text), "__doc": ident})
    both = own.join(sets, own["__doc"].eqNullSafe(sets["__id"]) & (own["__tkey"] == sets["__key"]), "left")
    lines = F.split(text, "\n")
    count = F.size(F.coalesce(lines, F.array(F.lit(""))))
    last_word = F.floor((count - 1) / BITS).cast("int")
    bitset = F.transform(F.sequence(F.lit(0), last_word),
                         lambda w: F.coalesce(F.element_at("__kept", w), F.lit(0).cast("long")))
    both = both.withColumns({"__lines": lines, "__n": count, "__bits": bitset})
    held = lambda i: F.getbit(F.get("__bits", F.floor(i / BITS).cast("int")), i % BITS) == 1
    both = both.withColumn("__out", F.filter("__lines", lambda x, i: held(i) | ~_written(x)))
    left = F.aggregate("__bits", F.lit(0), lambda acc, w: acc + F.bit_count(w))
    stats = F.struct(F.col("__n").cast("long").alias("n_lines"),
                     (F.col("__n") - F.size(F.coalesce("__out", F.array(F.lit(""))))).cast("long").alias("n_dropped"),
                     left.cast("long").alias("n_left"))
    out = []
    for c, p in zip(docs.columns, plain):
        out.append((F.array_join("__out", "\n") if c.lower() == text_col.lower() else F.col(p)).alias(c))
    return both.select(*out, stats.alias(name))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "lines.*", F.md5("text").alias("kept_md5"))
