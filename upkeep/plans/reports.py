"""Report-generator data: tagged records, training pairs, fixed-length id sequences and
templated cost reports (the text-generation model itself is not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.functions import tagged as tg
from upkeep.functions import text as tx
from upkeep.plans import lifespan as ls
from upkeep.session import materialize
from upkeep.sources import fixtures as fx

SEED = 42
# ---- fixed values (must equal the reference's training-pair preparation) -------------
PREFIX = "Buat laporan: "   # input prefix
MAX_LEN = 128               # sequence length (truncate / pad)
LABEL_PAD = -100            # label id of padding positions
# ---------------------------------------------------------------------------------------
PAD_ID, EOS_ID, UNK_ID, FIRST_ID = 0, 1, 2, 3  # this vocabulary's special ids
# Severity words of the lifespan vocabulary by maximum severity (0 = no complaint).
SEVERITY_WORD = {0: "Tidak Ada", 1: "Ringan", 2: "Sedang", 3: "Berat", 4: "Fatal"}
#: Name, days left, severity word, money.  Any four-slot sentence will do.
REPORT_TEMPLATE = "%s: sisa umur %s hari, keparahan tertinggi %s, biaya rata-rata Rp %s"
#: Words kept in the vocabulary of ``fixed_length_ids``; rarer ones read as unknown.
VOCAB_SIZE = 32000


def tagged_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: one row per (record, tag) with the stripped value."""
    p = fx.report_pairs(spark, sf_dir)
    return (p.select("pair_id", F.posexplode(tg.tag_pairs("linearized_data_input")).alias("pos", "kv"))
            .select("pair_id", F.col("pos").cast("long").alias("pos"),
                    F.col("kv.tag").alias("tag"), F.col("kv.value").alias("value")))


def tagged_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag order permuted by a keyed hash."""
    p = fx.report_pairs(spark, sf_dir)
    return p.select("pair_id", tg.permute_tags("linearized_data_input", "pair_id", SEED)
                    .alias("permuted"))


def augmented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 first half: originals plus tag-permuted copies (one explode pass), distinct."""
    p = fx.report_pairs(spark, sf_dir)
    both = F.array(F.col("linearized_data_input"),
                   tg.permute_tags("linearized_data_input", "pair_id", SEED))
    return (p.select(F.explode(both).alias("linearized_data_input"), "narasi_laporan_output")
            .distinct())


def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: permute, union, distinct, clean both texts, prefix the input."""
    a = augmented_pairs(spark, sf_dir)
    return a.select(
        F.concat(F.lit(PREFIX), tx.clean_report_text("linearized_data_input")).alias("clean_input"),
        tx.clean_report_text("narasi_laporan_output").alias("clean_output"))


def fixed_length_ids(spark: SparkSession, sf_dir: str, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """F13 + C31 over the prepared pairs (originals and tag-permuted copies): a vocabulary built by
    Spark (ids by corpus frequency, ties by token; 0 pad, 1 end, 2 unknown), input ids and labels of
    fixed length 128 (pad labels masked -100).

    Texts are cut to their first 127 tokens before they are exploded, and a text without tokens
    stays, as an end marker and padding.  A group is one pair."""
    pairs = augmented_pairs(spark, sf_dir).select(
        F.md5(F.concat_ws("|", F.coalesce("linearized_data_input", F.lit("")), "narasi_laporan_output")).alias("pair_key"),
        tx.tokens(F.concat(F.lit(PREFIX), tx.clean_report_text("linearized_data_input"))).alias("src"),
        tx.tokens(tx.clean_report_text("narasi_laporan_output")).alias("tgt"))
    # two inputs may read alike once cleaned; both are pairs of their own unless equal before
    pairs = materialize(pairs)
    words = pairs.select(F.explode(F.concat("src", "tgt")).alias("token"))
    top = (words.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), F.asc("token")).limit(vocab_size))  # bounded by vocab_size
    vocab = top.select("token", (F.row_number().over(
        Window.orderBy(F.desc("c"), F.asc("token")))  # over <= vocab_size rows
        + FIRST_ID - 1).cast("int").alias("id"))
    side = lambda c, k: F.transform(F.slice(c, 1, MAX_LEN - 1), lambda t, i: F.struct(
        F.lit(k).alias("side"), i.alias("pos"), t.alias("token")))
    toks = pairs.select("pair_key", F.explode(F.concat(side("src", 0), side("tgt", 1))).alias("t")).select("pair_key", "t.*")
    ided = toks.join(F.broadcast(vocab), "token", "left").select(
        "pair_key", "side", "pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    seq = ided.groupBy("pair_key").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "id"))).alias("s"))

    def padded(k, pad):
        ids = F.transform(F.filter(F.coalesce("s", F.array().cast(seq.schema["s"].dataType)),
                                   lambda x: x["side"] == k), lambda x: x["id"])
        full = F.concat(ids, F.array(F.lit(EOS_ID)))
        return F.array_join(F.concat(full, F.array_repeat(F.lit(pad), F.lit(MAX_LEN) - F.size(full))), ",")

    return pairs.join(seq, "pair_key", "left").select(
        "pair_key", F.size("src").cast("long").alias("n_input_tokens"), padded(0, PAD_ID).alias("input_ids"),
        F.size("tgt").cast("long").alias("n_label_tokens"), padded(1, LABEL_PAD).alias("labels"))


def scored_report_rows(spark: SparkSession, sf_dir: str, as_of: str = "2002-01-01",
                       predictions: DataFrame | None = None) -> DataFrame:
    """Labelled assets with their predicted lifespan (``predictions``: labelled assets with a column
    ``predicted``; by default the fixed predictor's): days left at ``as_of``, severity word and
    mean repair cost."""
    lab = predictions
    if lab is None:
        lab = ls.fixed_prediction(ls.labelled_assets(spark, sf_dir).withColumn("target", F.lit(0.0)))
    names = fx.assets(spark, sf_dir).select("id", "nama")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("tanggal_instalasi"))
    left = F.greatest(F.coalesce(F.col("predicted") - age, F.col("predicted")), F.lit(1.0))
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY_WORD.items() for x in kv])
    return lab.join(names, "id", "left").select(
        "id", "nama", left.cast("long").alias("days_left"),
        F.coalesce(sev[F.col("severity_max")], F.lit("Tidak Ada")).alias("severity_word"),
        F.round("biaya_mean").cast("long").alias("money"))


def linearize_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tagged record per scored asset."""
    r = scored_report_rows(spark, sf_dir)
    return r.select("id", tg.linearize("nama", "days_left", "severity_word", "money")
                    .alias("linearized_data_input"))


def asset_report_text(spark: SparkSession, sf_dir: str, predictions: DataFrame | None = None) -> DataFrame:
    """M9: templated cost report per asset, the asset name copied verbatim."""
    r = scored_report_rows(spark, sf_dir, predictions=predictions)
    return r.select("id", F.format_string(REPORT_TEMPLATE, "nama", F.col("days_left").cast("string"),
                                          "severity_word", tx.thousands_dots("money"))
                    .alias("report"))
