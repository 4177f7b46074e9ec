"""Quality rules as a bitmask ledger.

One pass over the texts evaluates every rule once and stores, per document, its measurements
and one failure bit per rule.  Policies are versioned masks over those bits: applying one is
``fail_bits & mask``, and comparing policies or leaving rules out (ablation) reads only the
ledger, whose distinct bit patterns are few.
"""

from __future__ import annotations

from dataclasses import dataclass

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import documents, fresh, with_text_column

_SYMBOLS = b"#*$%&|<>"
#: Capital Roman numerals and enclosed letters: upper case, but not upper-case letters.
_NUMERAL_CAPITALS = re.compile("[\u2160-\u216f\u24b6-\u24cf\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_letters", "n_digits", "n_marks")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules: a document is kept if it fails none of them."""
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self) -> int:
        names = list(RULE_SQL)
        return sum(1 << names.index(r) for r in self.rules)


#: Rules in bit order: each fails a document for which its condition holds.  Shares are compared
#: as products of whole numbers, so empty texts divide nothing.
RULE_SQL = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "n_letters >= 20 and 2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
    "digits": "5 * n_digits > word_chars",
    "shouted_marks": "4 * n_marks > n_words",
}
BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("corpus", 1, tuple(RULE_SQL)[:8]), Policy("corpus", 2, tuple(RULE_SQL)))
CURRENT = POLICIES[-1]


def measure(data: bytes) -> tuple[int, ...]:
    """The MEASURES of a UTF-8 text.  Words lie between x20 and x09-x0D; a repeated word is one
    inside a three-word window that the text holds twice or more."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    joined = b"".join(words)
    text = joined.decode()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    n_marks = joined.count(b"!") + joined.count(b"?")
    n_digits = len(joined) - len(joined.translate(None, b"0123456789"))
    if text.isascii():
        upper = len(joined) - len(joined.translate(None, bytes(range(65, 91))))
        letters = upper + len(joined) - len(joined.translate(None, bytes(range(97, 123))))
    else:
        upper = sum(map(str.isupper, text)) - len(_NUMERAL_CAPITALS.findall(text))
        letters = sum(map(str.isalpha, text))
    return (n, len(text), n_symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines),
            upper, letters, n_digits, n_marks)


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pair = ids[:-2] * size + ids[1:-1]
    if size ** 3 >= 1 << 63:  # three numbers do not fit in 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j:j + len(window)] |= again
    return int(covered.sum())


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """``docs`` with one more column, a struct of the MEASURES (long) and ``fail_bits`` (long; bit i
    is rule i of RULE_SQL).  The column is called ``name``, with underscores added if taken.

    A null text counts as empty: all measures are 0 and only the rules that hold for 0 fail.
    Rows are independent, so repeated rows and ids get equal results; other columns pass
    through untouched whatever their names.  No shuffle.
    """
    name = fresh(docs.columns, name)

    def make():
        def compute(texts):
            got = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
            return pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(MEASURES))],
                                              list(MEASURES))
        return compute

    measured = with_text_column(docs, text_col, name,
                                "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">", make)
    rules = []
    a_measure = re.compile(rf"\b({'|'.join(MEASURES)})\b")
    for i, condition in enumerate(RULE_SQL.values()):
        condition = a_measure.sub(lambda m: f"`{name}`.{m[0]}", condition)
        rules.append(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    bits = rules[0]
    for r in rules[1:]:
        bits = bits.bitwiseOR(r)
    return measured.withColumn(name, F.struct(*[F.col(f"`{name}`.{m}").alias(m) for m in MEASURES],
                                              bits.alias("fail_bits")))


def passes(fail_bits: Column, policy: Policy) -> Column:
    return fail_bits.bitwiseAND(F.lit(policy.mask()).cast("long")) == 0


def ablation(rows: DataFrame, fail_bits: str = "fail_bits",
             policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row per policy and rule: documents kept by the policy, documents that fail the rule,
    and documents that only this rule of the policy rejects (kept if it were left out).

    Documents are first counted by bit pattern, so what follows reads at most 2**rules rows.
    An empty table gives zeros.
    """
    patterns = rows.groupBy(F.col(fail_bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = list(RULE_SQL)
    sums = [F.sum(F.when(passes(F.col("bits"), p), F.col("n"))).alias(f"k{i}")
            for i, p in enumerate(policies)]
    for i, p in enumerate(policies):
        for r in p.rules:
            bit = 1 << names.index(r)
            failed = F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0
            only = F.col("bits").bitwiseAND(F.lit(p.mask()).cast("long")) == bit
            sums += [F.sum(F.when(failed, F.col("n"))).alias(f"f{i}_{r}"),
                     F.sum(F.when(only, F.col("n"))).alias(f"o{i}_{r}")]
    total = patterns.agg(*sums)
    out = []
    for i, p in enumerate(policies):
        for r in p.rules:
            out.append(F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"),
                                F.lit(r).alias("rule"),
                                F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("n_kept"),
                                F.coalesce(F.col(f"f{i}_{r}"), F.lit(0)).alias("n_failed"),
                                F.coalesce(F.col(f"o{i}_{r}"), F.lit(0)).alias("n_only_this")))
    return total.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = ledger(docs).select("doc_id", "ledger.*")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", (~passes(F.col("fail_bits"), BASE)).alias("base_failed"),
                       passes(F.col("fail_bits"), CURRENT).alias("kept"), "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's documents kept and what each of its rules does, over the whole ledger."""
    return ablation(ledger(documents(spark, sf_dir).select("doc_id", "text")).select("ledger.fail_bits"))
