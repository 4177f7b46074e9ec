"""Delimited text sources (S2-S6) with the reference's pandas semantics.

pandas ``read_csv(on_bad_lines='skip')`` skips a line with MORE fields than the header and
pads a line with fewer fields with missing values.  Spark's DROPMALFORMED drops both, and
PERMISSIVE flags both in the corrupt-record column; so the rule here is PERMISSIVE plus a
filter that keeps a flagged line only when it is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def string_schema(names: list[str], corrupt: bool = False) -> T.StructType:
    fields = [T.StructField(n, T.StringType(), True) for n in names]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def read_comma_csv(spark: SparkSession, path: str, schema: T.StructType,
                   multi_line: bool = False) -> DataFrame:
    """Comma CSV with a header and quoted fields that may hold commas.  Fields that hold line
    breaks need ``multi_line``, which reads every file in one task."""
    return (spark.read.schema(schema).option("header", True).option("quote", '"')
            .option("escape", '"').option("multiLine", multi_line).csv(path))


def read_pipe_csv(spark: SparkSession, path: str, names: list[str], header: bool = True,
                  sep: str = "|") -> DataFrame:
    """S3 + S5: delimited text read with caller-given column names; lines with too many
    fields are skipped, short lines are padded.  With ``header`` each file's first line is
    its header (the append sink writes one per part file)."""
    df = (spark.read.schema(string_schema(names, corrupt=True)).option("sep", sep)
          .option("header", header).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    bare = F.regexp_replace(F.col(CORRUPT), r'"(?:[^"]|"")*+"', "")  # separators in quotes are text
    n_fields = F.size(F.split(bare, "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep))
    keep = F.col(CORRUPT).isNull() | (n_fields <= len(names))
    # Spark refuses a scan whose only used column is the corrupt-record one (e.g. under a
    # bare count); touching the first data column keeps such plans legal.
    touch = F.length(F.coalesce(F.col(names[0]), F.lit(""))) >= 0
    return df.filter(keep & touch).drop(CORRUPT)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Pipe when the first line of the (single) file holds a pipe, else comma.  Only
    the first line is read (a limit-1 scan)."""
    first = spark.read.text(path).limit(1).collect()
    return "|" if first and "|" in (first[0][0] or "") else ","
