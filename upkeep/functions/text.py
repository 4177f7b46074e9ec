"""Text column functions (all JVM-side, whole-stage codegen friendly).

Whitespace is what Python's ``\\s``, ``split`` and ``strip`` take for it, spelled out by code point so
that the Java regex engine (Spark) and RE2 (the SQL oracle) agree.  Python's ``str.strip()`` removes
line breaks as well as blanks, while SQL ``trim`` removes blanks only, so stripping is a
regex here.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")
#: The same characters one by one.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000")
#: Runs of them for the Java engine, which tests its own class of blanks much faster than a list.
_WS = r"\s\x1C-\x1F"
_RUN = rf"(?U)[{_WS}]+"
NULL_TOKEN = "nan"  # what astype(str) makes of a missing text value


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c, null_token: str | None = NULL_TOKEN) -> Column:
    """astype(str): a missing value becomes ``null_token`` (None keeps it null)."""
    c = _c(c)
    return c if null_token is None else F.coalesce(c.cast("string"), F.lit(null_token))


def strip_ws(c) -> Column:
    """``t.strip()``: one pass from each end (a pattern for trailing blanks starts anew at every blank)."""
    return F.btrim(_c(c), F.lit(BLANKS))


def fold_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', t)``"""
    return F.regexp_replace(_c(c), _RUN, " ")


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', t).strip()``"""
    return F.btrim(fold_ws(c), F.lit(" "))


def symbols_to_blank(c) -> Column:
    """Every character outside ``[a-z0-9\\s]`` becomes a blank."""
    return F.regexp_replace(_c(c), rf"(?U)[^a-z0-9{_WS}]", " ")


def drop_non_letters(c) -> Column:
    """Every character outside ``[a-z\\s]`` is removed (digits too; words may fuse)."""
    return F.regexp_replace(_c(c), rf"(?U)[^a-z{_WS}]+", "")


def basic_clean(c, collapse: bool = False, null_token: str | None = NULL_TOKEN) -> Column:
    """C1+C2(+C4): lower, symbols to blanks, strip; ``collapse`` also folds whitespace."""
    t = symbols_to_blank(F.lower(as_text(c, null_token)))
    return collapse_ws(t) if collapse else strip_ws(t)


def strict_clean(c, null_token: str | None = NULL_TOKEN) -> Column:
    """C1+C3+C4: lower, drop non-letters, fold whitespace."""
    return collapse_ws(drop_non_letters(F.lower(as_text(c, null_token))))


def concat_text(a, b, null_token: str | None = NULL_TOKEN) -> Column:
    """``str(a) + ' ' + str(b)``."""
    return F.concat(as_text(a, null_token), F.lit(" "), as_text(b, null_token))


def tokens(c) -> Column:
    """``text.split()`` - whitespace tokens, no empty strings."""
    return F.filter(F.split(fold_ws(c), " "), lambda t: t != F.lit(""))


def join_tokens(arr: Column) -> Column:
    return F.array_join(arr, " ")


#: Words up to which a literal map, searched word by word, does.
FEW_WORDS = 16


def _lookup(mapping: dict):
    """A function from a word column to its value in ``mapping`` (null: none).

    Spark searches a map from end to end, so a larger mapping becomes an array of maps of a word or two,
    chosen by the word's CRC-32: the cost per word does not grow with the mapping (a task takes some
    seconds to read a literal of 50,000 words).  A mapping is a parameter that fits the driver, for more
    see ``operators.dictionary``."""
    if len(mapping) <= FEW_WORDS:
        m = F.create_map().cast("map<string,string>")
        if mapping:
            m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
        return lambda t: m[t]
    size = 1 << (len(mapping) - 1).bit_length()
    buckets: list[dict] = [{} for _ in range(size)]
    for word, value in mapping.items():
        buckets[zlib.crc32(word.encode()) % size][word] = value
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,string>>")
    return lambda t: F.get(table, F.pmod(F.crc32(t), F.lit(size)).cast("int"))[t]


def remove_words(toks: Column, words) -> Column:
    """Drop caller-listed words."""
    find = _lookup({w: "" for w in words})
    return F.filter(toks, lambda t: find(t).isNull())


def map_words(toks: Column, mapping: dict) -> Column:
    """Word-level substitution from a caller map (synonyms or lemma table)."""
    find = _lookup(mapping)
    return F.transform(toks, lambda t: F.coalesce(find(t), t))


def replace_words(c, mapping: dict) -> Column:
    """C10 on a text column: split, substitute, re-join."""
    return join_tokens(map_words(tokens(c), mapping))


def substitute_some(toks: Column, mapping: dict, key: Column, seed: int, p: float) -> Column:
    """C11: each word is replaced with probability ``p`` (keyed by row key, position and
    seed, so the result does not depend on partitioning) when the lexicon has it."""
    from upkeep.functions.keyed import uniform_of
    find = _lookup(mapping)

    def substituted(t, i):
        drawn = uniform_of(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(str(seed)))) < F.lit(p)
        return F.when(find(t).isNotNull(), F.when(drawn, find(t)).otherwise(t)).otherwise(t)

    return F.transform(toks, substituted)


def strip_sentinels(c) -> Column:
    """Remove ``<extra_id_N>`` tokens."""
    return F.regexp_replace(_c(c), r"<extra_id_\d+>", "")


# ---- fixed value (must equal the reference's report cleanup) ---------------------------
# Allowed characters of report text: word characters (letters, numbers, underscore),
# whitespace and . , ! ? - R p [ ] |  (everything else is removed)
REPORT_CHARSET = r"[^\p{L}\p{N}_" + WS[1:-1] + r"\.,!?\-Rp\[\]\|]"
# ---------------------------------------------------------------------------------------


def report_charset(c) -> Column:
    """C5."""
    return F.regexp_replace(_c(c), REPORT_CHARSET, "")


def clean_report_text(c) -> Column:
    """Missing -> '', fold whitespace, charset filter, strip."""
    c = _c(c)
    t = strip_ws(report_charset(fold_ws(c)))
    return F.when(c.isNull(), F.lit("")).otherwise(t)


FENCE = "```"


def strip_fences(c, policy: str = "replace") -> Column:
    """C17, three policies seen in the corpus jobs.

    replace      - remove every ```csv and ``` marker, then strip
    edge_lines   - if the text starts with ```, drop its first and last line
    when_present - like replace, but only when a marker is present
    """
    c = _c(c)
    removed = strip_ws(F.replace(F.replace(c, F.lit(FENCE + "csv"), F.lit("")),
                                 F.lit(FENCE), F.lit("")))
    if policy == "replace":
        return removed
    if policy == "when_present":
        return F.when(c.contains(FENCE), removed).otherwise(c)
    if policy == "edge_lines":
        lines = F.split(strip_ws(c), "\n")
        inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
        return F.when(c.startswith(FENCE), inner).otherwise(c)
    raise ValueError(policy)


def drop_header_line(c, prefix: str = "teks_keluhan") -> Column:
    """Drop the first line when it is a header."""
    c = _c(c)
    lines = F.split(c, "\n")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.when(F.lower(c).startswith(prefix), rest).otherwise(c)


def thousands_dots(x) -> Column:
    """4500000 -> '4.500.000'."""
    return F.translate(F.format_number(_c(x), 0), ",", ".")
