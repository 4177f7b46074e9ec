"""Landing of the maintenance tables.

The reference reads asset, complaint, schedule, replacement and ticket workbooks.  Here the
same shapes are derived from the shared test tables by integer arithmetic only (the
derivation rules are in FIXTURES.md, part B), so every query's work grows with the input
tables.  All derivations are narrow projections/filters except:

* complaints: lineitem joined to assets on the part key (a plain equi-join; AQE picks the
  strategy from runtime sizes, nothing is broadcast by hint);
* schedule: one distinct over the asset type columns (bounded by the number of types);
* responses: lines grouped five per batch (groups of a fixed, tiny size).
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions.text import thousands_dots

# ---- fixed values (must equal the fixture definition) --------------------------------
# Maintenance intervals from tightest to loosest; their 1-based position is the rank.
INTERVALS = ["Harian", "Mingguan", "Bulanan", "Tiga Bulanan", "Semester", "Tahunan", "Reaktif"]
# Criticality by p_size % 4 (3 -> missing).
CRITICALITY_BY_SIZE = ["Critical", "Major", "Minor", None]
# Complaint severity by line number 1..7 (7 is outside both severity vocabularies).
SEVERITY_BY_LINE = ["Ringan", "Ringan", "Sedang", "Sedang", "Berat", "Fatal", "Lainnya"]
# Cause by return flag.
CAUSE_BY_FLAG = {"A": "Aus", "N": "Tersumbat", "R": "Konsleting"}
# Severity words used in generated responses and report inputs, by p_size % 4.
REPORT_SEVERITY_BY_SIZE = ["Rendah", "Sedang", "Tinggi", "Kritis"]
# Header of the pipe-separated ticket file written by the corpus jobs.
TICKET_V2_HEADER = ("teks_keluhan_awam|teks_laporan_teknisi|kategori_aset|severity|"
                    "root_cause|jenis_kerusakan|biaya_perbaikan")
TICKET_V2_COLUMNS = TICKET_V2_HEADER.split("|")
TICKET_V1_COLUMNS = ["teks_keluhan_awam", "teks_laporan_teknisi", "kategori_aset",
                     "severity", "root_cause", "tindakan"]
# ---------------------------------------------------------------------------------------

DATE_FMT = "dd-MM-yyyy"


def own_table(derive):
    """Plans name their source as ``(spark, source)``: a folder of the shared test tables, from
    which ``derive`` makes the table, or a mapping of table names to the caller's DataFrames."""
    name = derive.__name__

    @functools.wraps(derive)
    def table(spark: SparkSession, source: str | Mapping[str, DataFrame]) -> DataFrame:
        if isinstance(source, Mapping):
            if name not in source:
                raise KeyError(f"the plan needs a table {name!r}; given: {sorted(source)}")
            return source[name]
        return derive(spark, source)

    return table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, idx: Column) -> Column:
    """0-based lookup into a constant list (null for a None entry)."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), idx + 1)


def _day_text(base: str, offset: Column) -> Column:
    return F.date_format(F.date_add(F.lit(base).cast("date"), offset.cast("int")), DATE_FMT)


def asset_id(key: Column) -> Column:
    """``A`` and the key, padded to six digits at least (longer keys keep all digits)."""
    return F.format_string("A%06d", key)


#: Bits of ``row_seq`` below the day; the order key of a complaint may use all but three.
SEQ_BITS = 48


def price_units(retail: Column) -> Column:
    """Integer money amount used by responses and report inputs."""
    return F.round(retail * 1000).cast("long")


@own_table
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        asset_id(k).alias("id"),
        F.col("p_name").alias("nama"),
        F.col("p_type").alias("kategori"),
        F.concat(F.lit("Sub"),
                 (F.regexp_replace("p_brand", "Brand#", "").cast("int") % 3).cast("string")
                 ).alias("sub_kategori"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("tipe"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("merek"),
        _pick(CRITICALITY_BY_SIZE, F.col("p_size") % 4).alias("tingkat_kekritisan"),
        F.when(k % 50 == 0, F.lit("00-00-0000"))
         .otherwise(_day_text("1988-01-01", (k * 37) % 2400)).alias("tanggal_instalasi"),
        F.concat(F.lit("G"), (F.col("p_size") % 3).cast("string")).alias("lokasi_gedung"),
        F.concat(F.lit("L"), (F.col("p_size") % 5).cast("string")).alias("lokasi_lantai"),
        F.concat(F.lit("Z"), (k % 4).cast("string")).alias("lokasi_zona"),
        k.alias("row_seq"),
    )


@own_table
def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    pk, ok, ln = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    kept = li.filter(pk % 10 != 0)  # every tenth asset stays without complaints
    a = assets(spark, sf_dir).select("id", "kategori", "sub_kategori", "tipe",
                                     F.col("row_seq").alias("l_partkey"))
    ship = F.to_date("l_shipdate")
    cause = F.create_map(*[x for kv in CAUSE_BY_FLAG.items() for x in map(F.lit, kv)])
    return kept.join(a, "l_partkey").select(
        "id", "kategori", "sub_kategori", "tipe",
        _pick(SEVERITY_BY_LINE, ln - 1).alias("severity"),
        cause[F.col("l_returnflag")].alias("penyebab"),
        F.col("l_linestatus").alias("jenis_kerusakan"),
        F.col("l_extendedprice").alias("biaya_perbaikan"),
        F.date_format(F.date_sub(ship, 3), DATE_FMT).alias("tanggal_perencanaan"),
        F.when(ok % 40 == 0, F.lit(None).cast("string"))
         .otherwise(F.date_format(ship, DATE_FMT)).alias("tanggal_pengerjaan"),
        F.date_format(F.date_add(ship, 2), DATE_FMT).alias("tanggal_selesai"),
        # Total order of a complaint inside its asset: ship day, then order line.  Order keys
        # beyond the bits kept for them are an error, never a wrong order.
        F.when((ok < 0) | (ok >= (1 << (SEQ_BITS - 3))),
               F.raise_error(F.lit("order key too large for row_seq")).cast("long"))
         .otherwise(F.datediff(ship, F.lit("1970-01-01").cast("date")).cast("long")
                    * F.lit(1 << SEQ_BITS) + ok * 8 + ln).alias("row_seq"),
    )


@own_table
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = assets(spark, sf_dir).select("kategori", "sub_kategori", "tipe").distinct()
    i = F.col("i")
    keep = ((F.length("kategori") + F.length("tipe")
             + F.expr("cast(right(sub_kategori, 1) as int)") + i)
            % (F.length("tipe") % 2 + 2) == 0) & (F.col("tipe") != "rod")
    return (types.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(len(INTERVALS)))))
            .filter(keep)
            .select("kategori", "sub_kategori", "tipe",
                    _pick(INTERVALS, i - 1).alias("frekuensi"), i.cast("long").alias("row_seq")))


@own_table
def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    first = F.struct(F.lit(0).cast("long").alias("row_seq"),
                     F.when(k % 11 == 0, F.lit(None).cast("string"))
                      .otherwise(_day_text("1999-01-01", (k * 53) % 1400)).alias("d"),
                     (k % 3 != 0).alias("keep"))
    second = F.struct(F.lit(1).cast("long").alias("row_seq"),
                      _day_text("2002-01-01", k % 90).alias("d"),
                      (k % 7 == 0).alias("keep"))
    rows = p.select(k, "p_name", F.explode(F.filter(F.array(first, second),
                                                    lambda r: r["keep"])).alias("r"))
    return rows.select(
        asset_id(k).alias("id"),
        F.col("p_name").alias("nama"),
        F.col("r.d").alias("tanggal_penggantian"),
        F.col("r.row_seq").alias("row_seq"),
    )


@own_table
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket table (v1 shape).  The complaint text is the document's first line and the
    technician text is the rest of the document, so the two fields together hold the
    whole text.  Every document is a ticket; without a label it lacks two targets."""
    d = _read(spark, sf_dir, "documents")
    lab = _read(spark, sf_dir, "labels")
    did = F.col("doc_id")
    first = F.substring_index("text", "\n", 1)
    rest = F.nullif(F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)"),
                    F.lit(""))
    return d.join(lab, "doc_id", "left").select(
        did.alias("ticket_id"),
        F.when(did % 23 == 0, F.lit(None).cast("string")).otherwise(first)
         .alias("teks_keluhan_awam"),
        F.when((did % 23 == 0) | (did % 29 == 0), F.lit(None).cast("string")).otherwise(rest)
         .alias("teks_laporan_teknisi"),
        F.col("source").alias("kategori_aset"),
        F.col("lang").alias("severity"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("root_cause"),
        F.when(did % 31 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("t"), F.col("toxic").cast("string"))).alias("tindakan"),
    )


@own_table
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generated-text responses, five pipe lines per batch, three wrapping styles."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    fields = F.array(
        F.concat(F.lit("keluhan "), F.col("p_name")),
        F.concat(F.lit("laporan "), F.col("p_brand")),
        F.col("p_type"),
        _pick(REPORT_SEVERITY_BY_SIZE, F.col("p_size") % 4),
        F.lit("Aus"),
        F.col("p_name"),
        price_units(F.col("p_retailprice")).cast("string"))
    fields = F.when(k % 17 == 0, F.slice(fields, 1, 6)).otherwise(fields)
    fields = F.when(k % 13 == 0, F.concat(fields, F.array(F.lit("x")))).otherwise(fields)
    lines = p.select((k / 5).cast("long").alias("batch_id"), k,
                     F.array_join(fields, "|").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))),
                                    lambda s: s["line"]), "\n")
    b = lines.groupBy("batch_id").agg(body.alias("body"))
    style = F.col("batch_id") % 3
    text = (F.when(style == 0, F.concat(F.lit("```csv\n"), "body", F.lit("\n```")))
             .when(style == 1, F.concat(F.lit(TICKET_V2_HEADER + "\n"), "body"))
             .otherwise(F.col("body")))
    return b.select("batch_id", text.alias("response_text"))


@own_table
def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    days = (k % 30 + 1).cast("string")
    money = thousands_dots(price_units(F.col("p_retailprice")))
    sev = _pick(REPORT_SEVERITY_BY_SIZE, F.col("p_size") % 4)
    tagged = F.concat(F.lit("[MESIN] "), "p_name", F.lit(" [STATUS] Prediksi Rusak "), days,
                      F.lit(" Hari [SEVERITY] "), sev, F.lit(" [ESTIMASI_BIAYA] Rp "), money)
    inp = (F.when(k % 40 == 0, F.lit(None).cast("string"))
            .when(k % 41 == 0, F.concat(F.lit("Catatan servis "), "p_name", F.lit(" tanpa tag")))
            .otherwise(tagged))
    out = F.concat(F.lit("Aset "), "p_name", F.lit(" ("), "p_brand",
                   F.lit(") diprediksi rusak dalam "), days,
                   F.lit(" hari; siapkan dana Rp "), money, F.lit("."))
    return p.select(k.alias("pair_id"), inp.alias("linearized_data_input"),
                    out.alias("narasi_laporan_output"))


@own_table
def done_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases already present in the ticket sink (for the resume job)."""
    c = complaints(spark, sf_dir).filter(F.length("severity") % 2 == 0)
    return c.select(F.col("kategori").alias("kategori_aset"), "severity",
                    F.col("penyebab").alias("root_cause"), "jenis_kerusakan").distinct()


@own_table
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings")


TABLES = {
    "assets": assets, "complaints": complaints, "schedule": schedule,
    "replacements": replacements, "tickets": tickets, "responses": responses,
    "report_pairs": report_pairs, "done_cases": done_cases, "embeddings": embeddings,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TABLES[name](spark, sf_dir)
