"""Training-corpus preparation jobs (K1-K8): value catalogues, the coverage queue of
distinct cases paired with a real asset, resume by anti join, normalisation of raw
generated responses into rows, prompt text per queued case.  The calls to a hosted text
model are not built: raw responses arrive as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import text as tx
from upkeep.functions.keyed import uniform_of
from upkeep.operators.ordering import (first_per_key, global_positions, null_safe_on,
                                       row_number_within)
from upkeep.sources import fixtures as fx

SEED = 42
CASE_KEYS = ["kategori", "severity", "penyebab", "jenis_kerusakan"]
COMBO_COLS = ["kategori", "sub_kategori", "tipe", "merek", "lokasi_gedung", "lokasi_lantai",
              "lokasi_zona"]
DONE_KEYS = ["kategori_aset", "severity", "root_cause", "jenis_kerusakan"]
N_FIELDS = len(fx.TICKET_V2_COLUMNS)


def _catalogue(df: DataFrame, cols: list[str], source: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("source", F.lit(source)))


def allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + A7: distinct non-missing values per column (with counts), from the complaint
    target columns and the asset identity/location columns; one aggregate per table."""
    c = _catalogue(fx.complaints(spark, sf_dir), ["severity", "penyebab", "jenis_kerusakan"],
                   "complaints")
    a = _catalogue(fx.assets(spark, sf_dir), COMBO_COLS, "assets")
    return c.unionByName(a).select("source", "column", "value", "n")


def valid_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: distinct complete asset combinations (P7 + A6)."""
    return fx.assets(spark, sf_dir).select(*COMBO_COLS).dropna(how="any").distinct()


def coverage_queue(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """K3 + J10: every distinct (category, severity, cause, damage) case once (first
    occurrence in file order), paired with one random real asset combination of the same
    category; cases whose category has no asset vanish.

    No product of cases and assets: combinations are numbered inside their category
    (skew-safe positions, a category may hold most assets), each case draws a number from
    a keyed hash, and the pair is an equi-join on (category, number)."""
    cases = first_per_key(fx.complaints(spark, sf_dir).select(*CASE_KEYS, "biaya_perbaikan",
                                                              "id", "row_seq"),
                          CASE_KEYS, ["id", "row_seq"]).drop("id", "row_seq")
    combos = row_number_within(valid_combinations(spark, sf_dir), ["kategori"],
                               COMBO_COLS[1:], rn_col="pick", size_col="n_cat")
    sizes = combos.select("kategori", "n_cat").distinct()
    key = F.concat_ws("|", *[tx.as_text(c) for c in CASE_KEYS], F.lit(str(seed)))
    drawn = (cases.join(sizes, "kategori", "inner")
             .withColumn("pick", (F.floor(uniform_of(key) * F.col("n_cat")) + 1).cast("long")))
    out = drawn.join(combos.drop("n_cat"), ["kategori", "pick"], "inner")
    return out.select("kategori", "tipe", "merek", "lokasi_gedung", "lokasi_lantai",
                      "lokasi_zona", "severity", "penyebab", "jenis_kerusakan", "biaya_perbaikan")


def queue_remaining(spark: SparkSession, sf_dir: str, done: DataFrame | None = None) -> DataFrame:
    """K4 + J9: queued cases not yet in the sink, matched on the four real key columns
    (a missing part matches a missing part).  ``done`` is the sink's table, e.g.
    ``sinks.table_or_empty(spark, path, schema)``; the test data's stand-in by default."""
    q = coverage_queue(spark, sf_dir)
    done = (fx.done_cases(spark, sf_dir) if done is None else done).select(
        F.col("kategori_aset").alias("kategori"), "severity",
        F.col("root_cause").alias("penyebab"), "jenis_kerusakan")
    return q.join(done, null_safe_on(q, done, CASE_KEYS), "left_anti")


def response_lines(responses: DataFrame, fence_policy: str = "replace") -> DataFrame:
    """K5 + C17 + C18 + S6: strip code fences, drop a header line, split into lines (blank
    lines skipped), count pipe fields and keep lines with at most the expected number (a
    longer line is skipped, a shorter one padded with missing values)."""
    text = tx.drop_header_line(tx.strip_fences("response_text", fence_policy))
    lines = responses.select("batch_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    lines = lines.filter(tx.strip_ws("line") != "")
    fields = F.split("line", r"\|")
    out = lines.withColumns({"line_no": (F.col("i") + 1).cast("long"),
                             "n_fields": F.size(fields).cast("long")})
    out = out.filter(F.col("n_fields") <= N_FIELDS)
    return out.select("batch_id", "line_no", "n_fields",
                      *[F.try_element_at(fields, F.lit(i + 1)).alias(c)
                        for i, c in enumerate(fx.TICKET_V2_COLUMNS)])


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rows plus a conformance flag: is the severity one of the allowed values."""
    rows = response_lines(fx.responses(spark, sf_dir))
    known = (fx.complaints(spark, sf_dir).select(F.col("severity").alias("_sev"))
             .filter(F.col("_sev").isNotNull()).distinct())
    flagged = rows.join(known, rows["severity"] == known["_sev"], "left")
    return flagged.withColumn("severity_known", F.col("_sev").isNotNull()).drop("_sev")


#: Fields of a response row that must repeat those of the case it was asked for.
CASE_FIELDS = {"kategori_aset": "kategori", "severity": "severity", "root_cause": "penyebab",
               "jenis_kerusakan": "jenis_kerusakan", "biaya_perbaikan": "money"}


def requested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queued case each response batch was asked for: batch numbers follow the queue in the order of a
    keyed hash of the case (the order in which ``coverage_queue`` is worked off)."""
    q = coverage_queue(spark, sf_dir)
    h = F.md5(F.concat_ws("|", *[tx.as_text(c) for c in CASE_KEYS], F.lit(str(SEED))))
    money = F.round("biaya_perbaikan").cast("long").cast("string")  # as the prompt writes it
    numbered = global_positions(q.withColumns({"_h": h, "money": money}), ["_h", *CASE_KEYS], pos_col="batch_id")
    return numbered.select("batch_id", *CASE_FIELDS.values())


def case_conformance(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """K5: every response row against the case of its batch, field by field (missing equals missing, blanks
    around a value do not count): ``matched`` (fields that agree), ``conforms`` and ``reason``, the names of
    the fields that differ, ``no case`` for a batch that nothing was asked for, null if all agree."""
    asked = cases.select(F.col("batch_id").alias("_b"), *[F.col(c).alias(f"_{c}") for c in CASE_FIELDS.values()])
    j = rows.join(asked, rows["batch_id"] == asked["_b"], "left")
    same = {f: F.when(tx.strip_ws(f) == "", None).otherwise(tx.strip_ws(f)).eqNullSafe(F.col(f"_{c}")) for f, c in CASE_FIELDS.items()}
    matched = sum((F.when(s, 1).otherwise(0) for s in same.values()), F.lit(0))
    differs = F.concat_ws(",", *[F.when(~s, F.lit(f)) for f, s in same.items()])
    known = F.col("_b").isNotNull()
    return j.select("batch_id", "line_no", *CASE_FIELDS,
                    F.when(known, matched).otherwise(0).cast("long").alias("matched"),
                    (known & (matched == len(CASE_FIELDS))).alias("conforms"),
                    F.when(~known, F.lit("no case")).when(matched < len(CASE_FIELDS), differs).alias("reason"))


def response_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_conformance(response_lines(fx.responses(spark, sf_dir)), requested_cases(spark, sf_dir))


#: Ten slots: category, type, brand, place (3), severity, cause, damage, cost.
PROMPT_TEMPLATE = ("Tugas: tulis tiga tiket perbaikan sebagai baris berpemisah pipa.\n"
                   "kategori=%s\ntipe=%s\nmerek=%s\ngedung=%s\nlantai=%s\nzona=%s\nseverity=%s\n"
                   "penyebab=%s\nkerusakan=%s\nbiaya=%s\n"
                   "Nilai di atas dipakai persis. Urutan kolom: " + fx.TICKET_V2_HEADER)


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: one prompt text per remaining queued case (text only; nothing is sent)."""
    q = queue_remaining(spark, sf_dir)
    money = F.round("biaya_perbaikan").cast("long").cast("string")
    return q.select(*CASE_KEYS, F.format_string(
        PROMPT_TEMPLATE, "kategori", "tipe", "merek", "lokasi_gedung", "lokasi_lantai",
        "lokasi_zona", "severity", "penyebab", "jenis_kerusakan", money).alias("prompt"))


def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response whose first raw line holds a pipe is pipe-separated, else comma."""
    first = F.substring_index("response_text", "\n", 1)
    return fx.responses(spark, sf_dir).select(
        "batch_id", F.when(first.contains("|"), F.lit("|")).otherwise(F.lit(",")).alias("sep"))


def ticket_read_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S5 on the appended ticket text: lines read with caller-given names, the
    bad-line rule applied, header lines found inside the data removed, then totals per
    field count (K6)."""
    rows = response_lines(fx.responses(spark, sf_dir))
    return rows.groupBy("n_fields").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_distinct("batch_id").alias("n_batches"))


def combination_sample(spark: SparkSession, sf_dir: str, n: int = 3, seed: int = SEED
                       ) -> DataFrame:
    """A uniform sample of ``n`` valid asset combinations (keyed-hash order, a bounded
    top-n; the limit is the feature)."""
    c = valid_combinations(spark, sf_dir)
    h = F.md5(F.concat_ws("|", *[F.col(x) for x in COMBO_COLS], F.lit(str(seed))))
    return c.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
