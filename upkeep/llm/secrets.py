"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Base findings are three patterns: assignments, access keys and long hexadecimal runs.  Besides
them every long token that mixes letters and digits is a candidate.  Candidate values are
hashed and counted over the corpus by distinct repositories and owners: a value spread over many
owners, or over many repositories of however few owners, is a copied example; a value that stays
with few of both and looks random, or that a base finding names as a secret elsewhere, is
reported as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, text_key
from upkeep.session import Scratch

#: Fixed values of the base patterns (kind, pattern, group that holds the value, least length).
KINDS = ("assign", "access", "hex")
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}+"  # 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Candidate tokens: 12 characters or more with a digit and a letter among them; and what
#: makes one look like a credential rather than a name.
CANDIDATE = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])"
             r"[A-Za-z0-9+/_=-]{12,}+")
LIVE_CHARS, LIVE_DISTINCT = 20, 10
#: From so many owners or repositories on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though a lambda in the body reads it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, zero: Column, join) -> Column:
    """What ``join`` makes of the numbers before each number of an array, ``zero`` before the first; in two
    levels of blocks, so that the cost stays near linear in the array's size."""
    def running(part):
        start = F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(
            join(acc["total"], x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out")))

    def blocks(v):
        last = F.ceil(F.size(v) / _BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: running(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(parts):
        offsets = running(F.transform(parts, lambda p: p["total"]))["out"]
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["out"], lambda x: join(x, o))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), joined)).otherwise(F.array().cast("array<bigint>")))


def _before(steps: Column) -> Column:
    """Sums of the numbers before each number of an array."""
    return _scan(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def _uncovered(spans: Column) -> Column:
    """The candidate tokens among sorted spans that overlap no base span: no earlier base span ends within
    or behind them, and the next one starts behind them."""
    none = F.lit(-1).cast("long")
    ends = F.transform(spans, lambda s: F.when(s["ord"] < 3, s["end"]).otherwise(none))
    far = F.lit(1 << 40).cast("long")
    starts = F.transform(F.reverse(spans), lambda s: F.when(s["ord"] < 3, s["start"]).otherwise(far))
    reached = _scan(ends, none, lambda a, b: F.greatest(a, b))
    coming = F.reverse(_scan(starts, far, lambda a, b: F.least(a, b)))
    near = F.zip_with(reached, coming, lambda r, c: F.struct(r.alias("reached"), c.alias("coming")))
    free = F.zip_with(spans, near, lambda s, n: F.when(
        (s["ord"] == 3) & (n["reached"] <= s["start"]) & (n["coming"] >= s["end"]), s))
    return F.filter(free, lambda s: s.isNotNull())


def _found(text: Column, needs: Column, pattern: str, group: int, kind: str, order: int,
           least: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, ord, end, kind, value), offsets in
    code points.  Lengths of the text between matches and of the matches add up to them.
    ``needs`` is a cheap test that every text with a match passes."""
    rx = F.lit(pattern)

    def spans_of(whole):
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        sizes = F.transform(whole, lambda m: F.length(m).cast("long"))
        values = F.regexp_extract_all(text, rx, F.lit(group)) if group else whole
        own = F.slice(gaps, 1, F.size(whole))
        starts = F.zip_with(_before(F.zip_with(own, sizes, lambda g, m: g + m)), own, lambda b, g: b + g)
        spans = F.zip_with(starts, sizes, lambda s, m: F.struct(s.alias("start"), (s + m).alias("end")))
        rows = F.zip_with(spans, values, lambda p, v: F.struct(
            p["start"].alias("start"), F.lit(order).alias("ord"), p["end"].alias("end"),
            F.lit(kind).alias("kind"), v.alias("value")))
        return F.filter(rows, lambda r: F.length(r["value"]) >= least)

    rows = _let(F.regexp_extract_all(text, rx, F.lit(0)), spans_of)
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>")
    return F.when(needs & text.rlike(pattern), rows).otherwise(none)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source", repository_col: str = "doc_id",
                 example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
                 scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``live`` (arrays of start, ord, end, kind,
    value; sorted), ``n_live`` and ``n_example`` (base values that are owner-specific, or copied by
    ``example_owners`` owners or into ``example_repositories`` repositories or more), ``counts`` (array
    of start, ord, n_owners, n_repositories of the base and live spans; sorted).

    A null text counts as empty; null owners and repositories each count as one; a repository
    belongs to an owner, so equal names of two owners count as two; repeated rows
    have equal results and count once in the frequencies; a live span never overlaps a base span;
    equal starts are ordered by kind.  Other columns are ignored whatever their names.  Runs
    Spark jobs and writes to the checkpoint folder; a ``scratch`` of the caller's lets it delete
    those tables once the result is stored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"))
    text = F.col("text")
    marks, digits = text.contains("=") | text.contains(":"), text.rlike("[0-9]")
    base = F.array_sort(F.concat(
        _found(text, marks, ASSIGN, 2, "assign", 0, 12),
        _found(text, text.contains("AKIA"), ACCESS, 0, "access", 1),
        _found(text, F.lit(True), HEX, 0, "hex", 2)))
    tokens = _found(text, digits, CANDIDATE, 0, "live", 3)
    rows = rows.select("doc_id", "owner", "repository", text_key(text).alias("tkey"), base.alias("base"), tokens.alias("tokens"))
    rows = scratch.write(rows.withColumn("all", F.array_sort(F.concat("base", "tokens"))).withColumn(
        "free", F.when(F.size("base") == 0, F.col("tokens")).otherwise(_uncovered(F.col("all")))).drop("all"))
    # one row per value and document at most, then per value and owner, then per value
    named = rows.select("owner", "repository", F.explode("base").alias("f"), F.lit(1).alias("named"))
    seen = rows.select("owner", "repository", F.explode("tokens").alias("f"), F.lit(0).alias("named"))
    values = named.union(seen).select(_hash(F.col("f.value")).alias("hash"), "owner", "repository", "named")
    by_repository = values.groupBy("hash", "owner", "repository").agg(F.max("named").alias("named"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"),
                                                          F.max("named").alias("named"))
    owned = scratch.write(by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"),
                                                       F.sum("n_repositories").alias("n_repositories"),
                                                       F.max("named").alias("named")))
    every = rows.select("doc_id", "tkey", F.explode(F.concat("base", "free")).alias("f"))
    judged = every.withColumn("hash", _hash(F.col("f.value"))).join(owned, "hash")
    value = F.col("f.value")
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    random = (F.length(value) >= LIVE_CHARS) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)
    is_base = F.col("f.ord") < 3
    live = ~is_base & ~example & ((F.col("named") == 1) | random)
    count = F.struct(F.col("f.start").alias("start"), F.col("f.ord").alias("ord"), "n_owners", "n_repositories")
    found = judged.groupBy("doc_id", "tkey").agg(
        F.array_sort(F.collect_set(F.when(live, F.col("f")))).alias("live"),
        F.size(F.collect_set(F.when(is_base & ~example, F.col("f")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(is_base & example, F.col("f")))).cast("long").alias("n_example"),
        F.array_sort(F.collect_set(F.when(is_base | live, count))).alias("counts"))
    found = found.select(F.col("doc_id").alias("id"), F.col("tkey").alias("key"), "live", "n_live", "n_example", "counts")
    out = rows.select("doc_id", "tkey", "base").join(
        found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tkey") == F.col("key")), "left")
    none = F.array().cast(found.schema["live"].dataType)
    uncounted = F.array().cast(found.schema["counts"].dataType)
    return out.select("doc_id", "base", F.coalesce("live", none).alias("live"),
                      (F.coalesce("n_live", F.lit(0)) + F.size(F.coalesce("live", none))).alias("n_live"),
                      F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
                      F.coalesce("counts", uncounted).alias("counts"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.array_sort(F.concat("base", "live"))).alias("spans"),
                        F.col("n_live").cast("long").alias("n_live"), "n_example")
