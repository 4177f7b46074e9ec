"""Quotation linking: replies find the messages they quote; conversations come out without quotes.

Lines that start with ``>`` marks are quoted, as many levels deep as there are marks.  Runs of
quoted lines of one level are passages.  Passages, and their longer lines, are normalised
(lower case, runs of other characters than letters and digits become one blank) and hashed; so
are the bodies and lines that messages wrote themselves.  A passage links to the earliest message
with that key: in its own conversation before it, else in the corpus.  A message answers the
message that its outermost quotes come from; a conversation's threads are its messages
under the first message of their chain of answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.llm.common import text_key
from upkeep.session import Scratch

#: Words that a single line needs to be a key by itself.
LINE_WORDS = 3
_MARKS = r"^ ?>[> ]*+"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse_lines(text: Column) -> Column:
    """Array of (level, body) of the lines of a text: level counts the quote marks, body is the
    line without them.  Lines that only introduce a quote ("On ... wrote:") get level -1."""
    lines = F.split(text, "\n")
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    parsed = F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARKS, "").alias("body")))
    after = F.concat(F.slice(parsed, 2, F.size(parsed)), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))))
    return F.zip_with(parsed, after, lambda x, y: F.struct(
        F.when((x["level"] == 0) & (y["level"] > 0) & x["body"].rlike(r"^On .* wrote:\s*$"), F.lit(-1))
        .otherwise(x["level"]).alias("level"), x["body"].alias("body")))


def passages(lines: Column) -> Column:
    """Runs of quoted lines of one level: array of (level, text).  ``lines`` is a column, not an expression
    (it is read once per run)."""
    empty = F.array().cast("array<struct<level:int,text:string>>")
    level = F.transform(lines, lambda x: x["level"])
    before = F.concat(F.array(F.lit(0)), F.slice(level, 1, F.greatest(F.size(level) - 1, F.lit(0))))
    changes = F.zip_with(level, before, lambda x, y: x != y)
    cuts = F.filter(F.transform(changes, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(cuts, 2, F.size(cuts)), F.array(F.size(lines)))
    runs = F.zip_with(cuts, ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    texts = F.transform(runs, lambda r: F.struct(
        F.get(lines, r["lo"])["level"].alias("level"),
        F.array_join(F.transform(F.slice(lines, r["lo"] + 1, r["hi"] - r["lo"]), lambda x: x["body"]), "\n").alias("text")))
    return F.when(F.exists(lines, lambda x: x["level"] > 0), F.filter(texts, lambda t: t["level"] > 0)).otherwise(empty)


def _keys(text: Column, lines: Column) -> Column:
    """Hashes of a normalised text (rank 0) and of its longer lines (rank 1): array of (key, rank)."""
    long = F.filter(F.transform(lines, _norm), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS)
    whole = F.filter(F.array(_norm(text)), lambda x: x != "")
    as_key = lambda rank: lambda x: F.struct(F.md5(x).alias("key"), F.lit(rank).alias("rank"))
    return F.array_distinct(F.concat(F.transform(whole, as_key(0)), F.transform(long, as_key(1))))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text",
                scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``messages``: ``conv_id``, ``turn``, ``role``, ``text`` (without quoted lines
    and their introductions, outer blanks cut), ``n_quotes`` (passages), ``n_linked`` (passages whose
    source was found), ``sources`` (sorted array of the (conv_id, turn) linked to), ``parent_turn``,
    ``thread`` (turn of the first message of the chain), ``depth``, ``path`` (turns from there to here).
    Ordered by (conv_id, path), a conversation reads in reply order.

    A null text counts as empty; a message without conversation or turn is never a source, and is
    its own thread; rows equal in conversation and turn share their chain of answers (that of the
    earliest parent); among equal texts the earliest message is the source.  Other columns are
    ignored whatever their names.  Every group is reduced to its two earliest conversations before a join, so
    common lines never pair up.  Runs Spark jobs and writes to the checkpoint folder; a ``scratch`` of
    the caller's lets it delete those tables once the result is stored.
    """
    scratch = scratch or Scratch(messages.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                           F.col(role_col).alias("role"), text_key(text).alias("tkey"),
                           parse_lines(text).alias("lines"))
    own_lines = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    body = F.btrim(F.array_join(own_lines, "\n"), F.lit(" \t\r\n"))
    rows = scratch.write(rows.select("conv_id", "turn", "role", "tkey", body.alias("text"), passages(F.col("lines")).alias("quotes"))
                         .withColumn("n_quotes", F.size("quotes").cast("long")))

    own = rows.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode(_keys(F.col("text"), F.split("text", "\n"))).alias("k"))
    in_conv = own.groupBy("conv_id", F.col("k.key").alias("key")).agg(F.min("turn").alias("turn"))
    # the two earliest conversations of every key: one of them is not the asking one
    earliest = Window.partitionBy("key").orderBy("conv_id")
    two = in_conv.withColumn("place", F.row_number().over(earliest)).filter("place <= 2")
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    in_corpus = two.groupBy("key").agg(at(1, "conv_id").alias("conv1"), at(1, "turn").alias("turn1"),
                                       at(2, "conv_id").alias("conv2"), at(2, "turn").alias("turn2"))

    quoted = rows.filter("n_quotes > 0").select("conv_id", "turn", "tkey", F.posexplode("quotes").alias("passage", "q"))
    asked = quoted.select("conv_id", "turn", "tkey", "passage", F.col("q.level").alias("level"),
                          F.explode(_keys(F.col("q.text"), F.split("q.text", "\n"))).alias("k"))
    asked = asked.select("conv_id", "turn", "tkey", "passage", "level", "k.key", "k.rank")
    near = in_conv.withColumnRenamed("turn", "near_turn")
    met = asked.join(near, ["conv_id", "key"], "left").join(in_corpus, "key", "left")
    close = F.col("near_turn") < F.col("turn")
    own_first = F.col("conv1").eqNullSafe(F.col("conv_id"))
    met = met.select("conv_id", "turn", "tkey", "passage", "level", "rank",
                     F.when(close, F.col("conv_id")).when(own_first, F.col("conv2")).otherwise(F.col("conv1")).alias("src_conv"),
                     F.when(close, F.col("near_turn")).when(own_first, F.col("turn2")).otherwise(F.col("turn1")).alias("src_turn"))
    # of a passage's keys the whole text counts before lines, its own conversation before others
    rank = F.struct((~F.col("src_conv").eqNullSafe(F.col("conv_id"))).alias("other"), "rank", "src_conv", "src_turn")
    best = met.filter("src_turn is not null").groupBy("conv_id", "turn", "tkey", "passage", "level").agg(
        F.min(rank).alias("s"))
    parent = F.when((F.col("level") == 1) & ~F.col("s.other"), F.col("s.src_turn"))
    links = scratch.write(best.groupBy("conv_id", "turn", "tkey").agg(
        F.count(F.lit(1)).alias("n_linked"), F.max(parent).alias("parent_turn"),
        F.array_sort(F.collect_set(F.struct(F.col("s.src_conv").alias("conv_id"), F.col("s.src_turn").alias("turn")))).alias("sources")))

    # chains of answers, doubled each round; a parent is always an earlier turn
    chains = scratch.write(links.filter("parent_turn is not null and conv_id is not null").groupBy("conv_id", "turn")
                           .agg(F.min("parent_turn").alias("top"))
                           .withColumn("path", F.array("top", "turn")))
    while True:
        up = chains.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("path").alias("above"))
        if chains.join(up, ["conv_id", "top"], "left_semi").isEmpty():
            break
        chains = scratch.write(chains.join(up, ["conv_id", "top"], "left").select(
            "conv_id", "turn", F.coalesce("higher", "top").alias("top"),
            F.when(F.col("above").isNotNull(), F.concat("above", F.slice("path", F.lit(2), F.size("path"))))
            .otherwise(F.col("path")).alias("path")))

    link = links.select(*[F.col(c).alias(f"l_{c}") for c in links.columns])
    out = rows.join(link, rows["conv_id"].eqNullSafe(link["l_conv_id"]) & rows["turn"].eqNullSafe(link["l_turn"])
                    & (rows["tkey"] == link["l_tkey"]), "left")
    out = out.join(chains.select("conv_id", "turn", "path"), ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    none = F.array().cast("array<struct<conv_id:bigint,turn:bigint>>")
    return out.select("conv_id", "turn", "role", "text", "n_quotes",
                      F.coalesce("l_n_linked", F.lit(0).cast("long")).alias("n_linked"),
                      F.coalesce("l_sources", none).alias("sources"), F.col("l_parent_turn").alias("parent_turn"),
                      F.get(path, F.lit(0)).alias("thread"), (F.size(path) - 1).cast("long").alias("depth"),
                      path.alias("path"))


def chat_turns(linked: DataFrame) -> DataFrame:
    """The messages of ``link_quotes`` as chat text: ``<|role|>``, the text and ``<|end|>`` on lines
    of their own, and the key to sort a conversation by."""
    role = F.coalesce("role", F.lit("user"))
    return linked.select("*", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("formatted"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent_turn`` is -1 for messages that answer none."""
    turns = chat_turns(link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return turns.select("conv_id", "turn", "n_quotes", "n_linked",
                        F.coalesce("parent_turn", F.lit(-1).cast("long")).alias("parent_turn"), "thread", "depth",
                        F.array_join("path", "/").alias("path"), F.md5("formatted").alias("formatted_md5"))
