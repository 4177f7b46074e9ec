"""Tagged records ``[TAG] value [TAG] value`` (C20 parse, C21 permutation, C22 build)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions.text import strip_ws, thousands_dots

# ---- fixed value (must equal the reference's tagged-record pattern) -------------------
# Tag followed by its value (everything up to the next '[').
TAG_PATTERN = r"(\[[A-Z_]+\])\s*([^\[]+)"
# ---------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_pairs(c) -> Column:
    """Array of (tag, value) structs in text order; values stripped."""
    c = _c(c)
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(TAG_PATTERN), 1).alias("tag"),
                        F.transform(F.regexp_extract_all(c, F.lit(TAG_PATTERN), 2),
                                    lambda v: strip_ws(v)).alias("value"))


def permute_tags(c, key, seed: int) -> Column:
    """Reorder the tagged parts by a keyed hash of (tag, row key, seed) and re-join as
    ``tag value`` with blanks; missing text stays missing, text without tags is unchanged.
    """
    c, key = _c(c), _c(key)
    pairs = tag_pairs(c)
    keyed = F.transform(pairs, lambda p: F.struct(
        F.md5(F.concat_ws("|", p["tag"], key.cast("string"), F.lit(str(seed)))).alias("h"),
        F.concat(p["tag"], F.lit(" "), p["value"]).alias("t")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["t"]), " ")
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(F.size(pairs) == 0, c).otherwise(joined)


def linearize(name, days, severity, money) -> Column:
    """Row -> ``[MESIN] name [STATUS] Prediksi Rusak n Hari [SEVERITY] s [ESTIMASI_BIAYA]
    Rp 4.500.000``."""
    return F.concat(F.lit("[MESIN] "), _c(name), F.lit(" [STATUS] Prediksi Rusak "),
                    _c(days).cast("string"), F.lit(" Hari [SEVERITY] "), _c(severity),
                    F.lit(" [ESTIMASI_BIAYA] Rp "), thousands_dots(_c(money)))
