"""Words mapped or dropped by a table of any size (C10 synonyms, C12 stop words, C13 base forms).

The distinct words of the texts are joined to the table once.  What both hold is often small: up to
LITERAL_WORDS entries (counted) become a literal that every row looks its words up in, without a shuffle of
texts.  Beyond that the texts' words are joined to it as rows and put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.functions import text as tx
from upkeep.session import Scratch

LITERAL_WORDS = 100_000


def map_by_table(df: DataFrame, key: str, words: str, table: DataFrame, scratch: Scratch | None = None,
                 literal_words: int | None = None) -> DataFrame:
    """``df`` with the array column ``words`` rewritten by ``table`` (word, value): a word of the table becomes
    its value, or goes where the value is null; other words stay.  ``key`` tells rows apart.  Of several rows
    for a word the smallest value counts (null first); null arrays stay null."""
    scratch = scratch or Scratch(df.sparkSession)
    limit = LITERAL_WORDS if literal_words is None else literal_words
    one = F.struct(F.col("value").isNotNull().alias("has"), "value")
    entries = table.filter("word is not null").groupBy("word").agg(F.min(one).alias("v")).select("word", "v.value")
    seen = df.select(F.explode(words).alias("word")).distinct()
    hits = scratch.write(seen.join(entries, "word"))
    if hits.count() <= limit:
        found = hits.collect()  # LITERAL_WORDS rows at most
        kept = tx.remove_words(F.col(words), [r.word for r in found if r.value is None])
        return df.withColumn(words, tx.map_words(kept, {r.word: r.value for r in found if r.value is not None}))
    spread = df.select(key, F.posexplode(words).alias("pos", "word")).join(
        hits.withColumn("hit", F.lit(True)), "word", "left")
    spread = spread.filter(F.col("hit").isNull() | F.col("value").isNotNull())
    rebuilt = spread.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", "word").alias("w")))).alias("_w"))
    rebuilt = rebuilt.select(F.col(key).alias("_k"), F.transform("_w", lambda x: x["w"]).alias("_w"))
    none = F.array().cast("array<string>")
    out = df.join(rebuilt, F.col(key).eqNullSafe(F.col("_k")), "left")
    new = F.when(F.col(words).isNotNull(), F.coalesce("_w", none))
    return out.select(*[new.alias(c) if c == words else F.col(c) for c in df.columns])
