"""DuckDB oracle SQL per query name.  Written independently of the Spark plans: window
functions and plain aggregates over the fixture CTEs.  Literals are cast to DOUBLE
because DuckDB reads ``0.3`` as DECIMAL."""

from __future__ import annotations

from upkeep.oracle.fixtures_sql import with_fixtures

# ---- fixed values, written out again so that a wrong one in the plans shows --------------
GRADED = {"Ringan": 1, "Sedang": 2, "Berat": 3, "Fatal": 4}
CRITICALITY = {"Critical": 1.0, "Major": 0.6, "Minor": 0.2}
RANKS = {"Harian": 1, "Mingguan": 2, "Bulanan": 3, "Tiga Bulanan": 4, "Semester": 5, "Tahunan": 6,
         "Reaktif": 7}
STOP_WORDS = ["the", "of", "and", "de", "to", "in", "la", "a", "der", "en", "is"]
LEMMAS = {"was": "be", "are": "be", "les": "le", "des": "de", "die": "der", "une": "un",
          "est": "etre", "ist": "sein", "has": "have", "had": "have"}
SYNONYMS = {"that": "which", "with": "alongside", "for": "toward", "on": "upon"}
LEXICON = {"it": "this", "as": "like", "by": "via", "from": "out", "at": "near", "an": "one",
           "this": "that", "que": "qui", "und": "oder", "et": "ou"}
# ---------------------------------------------------------------------------------------
D = "::DOUBLE"
AS_OF = "DATE '2002-01-01'"


def case_map(col: str, mapping: dict, default, double: bool = False) -> str:
    cast = D if double else ""
    arms = " ".join(f"WHEN '{k}' THEN {v}{cast}" for k, v in sorted(mapping.items()))
    return f"CASE {col} {arms} ELSE {default}{cast} END"


def rank_sql(col: str) -> str:
    return case_map(col, RANKS, 99)


SEV_I = case_map("severity", GRADED, 2)
SEV_L = case_map("severity", GRADED, 1)
CRIT_W = case_map("tingkat_kekritisan", CRITICALITY, 0.3, double=True)


def pdate(col: str) -> str:
    return f"CAST(try_strptime({col}, '%d-%m-%Y') AS DATE)"


# --- shared CTEs -------------------------------------------------------------------------
COND = [
    ("counts", f"""SELECT id, count(id) AS jumlah_komplain, avg({SEV_I}) AS rata_severity
                   FROM complaints WHERE id IS NOT NULL GROUP BY id"""),
    ("cond", f"""SELECT a.*, coalesce(c.jumlah_komplain, 0) AS jumlah_komplain,
                        coalesce(c.rata_severity, 0{D}) AS rata_severity,
                        greatest(coalesce(datediff('day', {pdate('a.tanggal_instalasi')}, {AS_OF})
                                          / 365.25{D}, 0{D}), 0{D}) AS umur_aset_tahun
                 FROM assets a LEFT JOIN counts c ON a.id = c.id"""),
]
LISTS = [
    ("firsts", """SELECT kategori, sub_kategori, tipe, frekuensi, min(row_seq) AS first_seq
                  FROM schedule WHERE kategori IS NOT NULL AND sub_kategori IS NOT NULL
                    AND tipe IS NOT NULL GROUP BY ALL"""),
    ("lists", f"""SELECT kategori, sub_kategori, tipe,
                         list(frekuensi ORDER BY {rank_sql('frekuensi')}, first_seq) AS intervals
                  FROM firsts GROUP BY ALL"""),
]
ASSIGN = COND + LISTS + [
    ("scored", f"""SELECT c.*, l.intervals,
        ((least(c.jumlah_komplain / 10{D}, 1{D}) * 0.30{D} + (c.rata_severity / 4{D}) * 0.30{D})
          + {CRIT_W.replace('tingkat_kekritisan', 'c.tingkat_kekritisan')} * 0.20{D})
          + least(c.umur_aset_tahun / 10{D}, 1{D}) * 0.20{D} AS urgency
        FROM cond c LEFT JOIN lists l ON c.kategori = l.kategori
          AND c.sub_kategori = l.sub_kategori AND c.tipe = l.tipe"""),
    ("assigned", """SELECT id, kategori, sub_kategori, tipe, tingkat_kekritisan, jumlah_komplain,
        rata_severity, umur_aset_tahun, urgency,
        CAST(coalesce(len(intervals), 0) AS BIGINT) AS n_intervals,
        CASE WHEN intervals IS NULL OR len(intervals) = 0 THEN NULL
             WHEN len(intervals) = 1 THEN intervals[1]
             ELSE intervals[1 + least(greatest(CAST(trunc((1::DOUBLE - urgency)
                  * (len(intervals) - 1)) AS INTEGER), 0), len(intervals) - 1)] END AS frekuensi
        FROM scored"""),
]

SQL: dict[str, str] = {}

SQL["interval_assignment"] = with_fixtures(
    ["assets", "complaints", "schedule"], ASSIGN, "SELECT * FROM assigned")

SQL["interval_distribution"] = with_fixtures(
    ["assets", "complaints", "schedule"], ASSIGN,
    "SELECT frekuensi, count(*) AS n_assets FROM assigned WHERE frekuensi IS NOT NULL GROUP BY 1")

SQL["asset_complaint_rollup"] = with_fixtures(
    ["assets", "complaints"], COND,
    "SELECT id, kategori, tingkat_kekritisan, jumlah_komplain, rata_severity FROM cond")

SQL["schedule_fanout"] = with_fixtures(
    ["assets", "complaints", "schedule"], COND,
    """SELECT c.id, c.kategori, c.sub_kategori, c.tipe, c.tingkat_kekritisan, c.jumlah_komplain,
              c.rata_severity, s.frekuensi, s.row_seq AS schedule_seq
       FROM cond c JOIN schedule s ON c.kategori IS NOT DISTINCT FROM s.kategori
        AND c.sub_kategori IS NOT DISTINCT FROM s.sub_kategori AND c.tipe IS NOT DISTINCT FROM s.tipe
       WHERE s.frekuensi IS NOT NULL""")

SQL["schedule_first"] = with_fixtures(
    ["assets", "schedule"], [],
    """SELECT kategori, sub_kategori, tipe, frekuensi FROM (
         SELECT *, row_number() OVER (PARTITION BY kategori, sub_kategori, tipe ORDER BY row_seq) rn
         FROM schedule) WHERE rn = 1""")

SQL["interval_lists"] = with_fixtures(
    ["assets", "schedule"], LISTS,
    """SELECT kategori, sub_kategori, tipe, CAST(len(intervals) AS BIGINT) AS n_intervals,
              array_to_string(intervals, ',') AS intervals FROM lists""")


# --- keyed random numbers in DuckDB (same digits as the Spark expressions) ------------------
def u_sql(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496{D})"


def key_sql(*parts: str, seed: int = 42) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + f", '{seed}')"


def gauss_sql(*parts: str, seed: int = 42) -> str:
    k = key_sql(*parts, seed=seed)
    return (f"(sqrt(-2{D} * ln(1{D} - {u_sql(k + chr(32) + '|| ' + repr('|g1'))}))"
            f" * cos(6.283185307179586{D} * {u_sql(k + chr(32) + '|| ' + repr('|g2'))}))")


def iso_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


LIFE_BASE = [
    ("dated", f"""SELECT *, {pdate('tanggal_pengerjaan')} AS tanggal FROM complaints
                  WHERE {pdate('tanggal_pengerjaan')} IS NOT NULL"""),
    ("repl", f"""SELECT id, tanggal_penggantian FROM (
                   SELECT id, {pdate('tanggal_penggantian')} AS tanggal_penggantian,
                          row_number() OVER (PARTITION BY id ORDER BY row_seq) AS rn
                   FROM replacements WHERE {pdate('tanggal_penggantian')} IS NOT NULL)
                 WHERE rn = 1"""),
    ("sched1", """SELECT kategori, sub_kategori, tipe, frekuensi FROM (
                    SELECT *, row_number() OVER (PARTITION BY kategori, sub_kategori, tipe
                                                 ORDER BY row_seq) AS rn FROM schedule)
                  WHERE rn = 1"""),
    ("aparsed", f"""SELECT id, {pdate('tanggal_instalasi')} AS inst, kategori, sub_kategori, tipe,
                           merek, tingkat_kekritisan FROM assets"""),
]
NS = ("{a}.kategori IS NOT DISTINCT FROM {b}.kategori AND {a}.sub_kategori IS NOT DISTINCT FROM "
      "{b}.sub_kategori AND {a}.tipe IS NOT DISTINCT FROM {b}.tipe")
HIST = LIFE_BASE + [
    ("cbase", f"""SELECT d.*, a.inst, a.merek, a.tingkat_kekritisan, r.tanggal_penggantian,
                         s.frekuensi
                  FROM dated d LEFT JOIN aparsed a ON d.id = a.id JOIN repl r ON d.id = r.id
                  LEFT JOIN sched1 s ON {NS.format(a='d', b='s')}"""),
    ("rul", """SELECT *, datediff('day', tanggal, tanggal_penggantian) AS target_rul FROM cbase
               WHERE datediff('day', tanggal, tanggal_penggantian) >= 0"""),
    ("hist", f"""SELECT id, row_seq, tanggal, target_rul,
            datediff('day', inst, tanggal) AS umur_saat_komplain,
            row_number() OVER w AS total_komplain_historis,
            coalesce(datediff('day', lag(tanggal) OVER w, tanggal),
                     datediff('day', inst, tanggal)) AS jarak_servis_sebelumnya,
            CAST({SEV_L} AS BIGINT) AS severity_num,
            CAST(max({SEV_L}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)
              AS max_severity_3,
            biaya_perbaikan,
            CASE WHEN datediff('day', inst, tanggal) + 1 = 0 THEN NULL
                 ELSE biaya_perbaikan / (datediff('day', inst, tanggal) + 1) END AS cost_density,
            kategori, sub_kategori, tipe, merek, tingkat_kekritisan, frekuensi
          FROM rul WINDOW w AS (PARTITION BY id ORDER BY tanggal, row_seq)"""),
    ("hsplit", """SELECT *, (row_number() OVER (ORDER BY tanggal, id, row_seq) - 1)
                          < (count(*) OVER ()) * 4 // 5 AS is_train FROM hist"""),
]
LIFE_FIX = ["assets", "complaints", "schedule", "replacements"]

SQL["rul_target"] = with_fixtures(LIFE_FIX, HIST, f"""
SELECT id, row_seq, {iso_sql('tanggal')} AS tanggal,
       {iso_sql('tanggal_penggantian')} AS tanggal_penggantian, target_rul FROM rul""")

SQL["complaint_history_features"] = with_fixtures(LIFE_FIX, HIST, f"""
SELECT * REPLACE ({iso_sql('tanggal')} AS tanggal) FROM hist""")

_K = key_sql("id", "row_seq")
SQL["penalty_target"] = with_fixtures(LIFE_FIX, HIST + [
    ("pen", f"""SELECT id, row_seq,
        CAST(2000 - umur_saat_komplain - severity_num * 150 - total_komplain_historis * 40
             AS DOUBLE) AS base_rul,
        CAST(floor({u_sql(_K)} * 13) + 1 AS BIGINT) AS floor_draw,
        {gauss_sql('id', 'row_seq')} AS z FROM hist""")], """
SELECT id, row_seq, base_rul, floor_draw,
       abs(greatest(CAST(floor_draw AS DOUBLE), base_rul)) AS target_noise0,
       round(abs(greatest(CAST(floor_draw AS DOUBLE), base_rul) + 10::DOUBLE * z), 6) AS target_keyed
FROM pen""")

SQL["time_split"] = with_fixtures(LIFE_FIX, HIST, f"""
SELECT id, row_seq, {iso_sql('tanggal')} AS tanggal, is_train FROM hsplit""")

_cols3 = ["umur_saat_komplain", "jarak_servis_sebelumnya", "cost_density"]
_jit = ",\n".join(
    f"round(abs(CAST({c} AS DOUBLE) + s_{i} * 0.03{D} * "
    f"{gauss_sql('id', 'row_seq', 'copy', repr(c))}), 6) AS {c}"
    for i, c in enumerate(_cols3))
SQL["critical_oversample"] = with_fixtures(LIFE_FIX, HIST + [
    ("train", "SELECT * FROM hsplit WHERE is_train"),
    ("copied", "SELECT t.*, unnest([1, 2]) AS copy FROM train t WHERE target_rul <= 60"),
    ("stds", "SELECT " + ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS s_{i}"
                                    for i, c in enumerate(_cols3)) + " FROM copied"),
], f"""
SELECT id, row_seq, 0 AS copy, target_rul,
       {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _cols3)} FROM train
UNION ALL
SELECT id, row_seq, copy, target_rul, {_jit} FROM copied, stds""")

ASSET = LIFE_BASE + [
    ("gaps", """SELECT id, datediff('day', lag(tanggal) OVER (PARTITION BY id ORDER BY tanggal, row_seq),
                                     tanggal) AS gap FROM dated"""),
    ("gapmean", "SELECT id, avg(gap) AS gm FROM gaps GROUP BY id"),
    ("roll", f"""SELECT id, count(tanggal) AS total_komplain, avg({SEV_L}) AS severity_mean,
                        max({SEV_L}) AS severity_max, sum(biaya_perbaikan) AS biaya_total,
                        avg(biaya_perbaikan) AS biaya_mean
                 FROM dated WHERE id IS NOT NULL GROUP BY id"""),
    ("lab0", f"""SELECT r.id, r.tanggal_penggantian, a.inst, a.kategori, a.sub_kategori, a.tipe,
                        a.merek, a.tingkat_kekritisan, s.frekuensi,
                        coalesce(ro.total_komplain, 0) AS total_komplain,
                        coalesce(ro.severity_mean, 0) AS severity_mean,
                        CAST(coalesce(ro.severity_max, 0) AS INTEGER) AS severity_max,
                        coalesce(ro.biaya_total, 0) AS biaya_total,
                        coalesce(ro.biaya_mean, 0) AS biaya_mean, g.gm
                 FROM repl r JOIN aparsed a ON r.id = a.id
                 LEFT JOIN sched1 s ON {NS.format(a='a', b='s')}
                 LEFT JOIN roll ro ON r.id = ro.id LEFT JOIN gapmean g ON r.id = g.id"""),
    ("lab1", """SELECT *, (row_number() OVER (ORDER BY tanggal_penggantian, id) - 1)
                            < (count(*) OVER ()) * 4 // 5 AS fitted FROM lab0"""),
    ("lab", """SELECT * EXCLUDE (gm, fitted), coalesce(gm, (SELECT median(gm) FROM lab1 WHERE fitted))
                 AS hari_antar_komplain_mean FROM lab1"""),
    ("life", f"""SELECT *, abs(3000{D} - total_komplain * 80 - severity_max * 250
                             - ln(1 + biaya_total) * 20) AS target_noise0,
                        abs(3000{D} - total_komplain * 80 - severity_max * 250
                             - ln(1 + biaya_total) * 20 + 30{D} * {gauss_sql('id')}) AS target_keyed
                 FROM lab"""),
    ("asplit", """SELECT *, target_noise0 AS target,
                         (row_number() OVER (ORDER BY tanggal_penggantian, id) - 1)
                           < (count(*) OVER ()) * 4 // 5 AS is_train FROM life"""),
    ("tpred", """SELECT *, abs(predicted - actual) AS error FROM (
                   SELECT *, round_even(target, 0) AS actual,
                          round_even(2950::DOUBLE - total_komplain * 75 - severity_max * 240, 0) AS predicted
                   FROM asplit WHERE NOT is_train)"""),
]

SQL["asset_rollup_full"] = with_fixtures(LIFE_FIX, ASSET, f"""
SELECT id, {iso_sql('tanggal_penggantian')} AS tanggal_penggantian, kategori, sub_kategori, tipe,
       merek, tingkat_kekritisan, frekuensi, total_komplain, round(severity_mean, 6) AS severity_mean,
       severity_max, round(biaya_total, 6) AS biaya_total, round(biaya_mean, 6) AS biaya_mean,
       round(hari_antar_komplain_mean, 6) AS hari_antar_komplain_mean,
       round(ln(1 + biaya_total), 6) AS biaya_total_log, round(ln(1 + biaya_mean), 6) AS biaya_mean_log
FROM lab""")

SQL["lifespan_target"] = with_fixtures(LIFE_FIX, ASSET, """
SELECT id, round(target_noise0, 6) AS target_noise0, round(target_keyed, 6) AS target_keyed FROM life""")

_TE = ["kategori", "sub_kategori", "tipe", "merek", "tingkat_kekritisan", "frekuensi"]
SQL["target_encoding"] = with_fixtures(LIFE_FIX, ASSET + [
    ("tr", "SELECT * FROM asplit WHERE is_train"),
    ("prior", "SELECT avg(target) AS prior FROM tr"),
    ("st", "SELECT col, val, count(*) AS n, avg(target) AS mean FROM ("
           + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS val, target FROM tr"
                                for c in _TE) + ") GROUP BY col, val"),
    ("enc", f"""SELECT col, val, CASE WHEN n = 1 THEN prior
                  ELSE prior * (1{D} - w) + mean * w END AS enc
                FROM (SELECT st.*, p.prior, 1{D} / (1{D} + exp(-(n - 20) / 10{D})) AS w
                      FROM st, prior p)"""),
], "SELECT s.id, s.is_train, " + ", ".join(
    f"round(coalesce(e{i}.enc, (SELECT prior FROM prior)), 6) AS te_{c}" for i, c in enumerate(_TE))
   + " FROM asplit s " + " ".join(
    f"LEFT JOIN enc e{i} ON e{i}.col = '{c}' AND e{i}.val IS NOT DISTINCT FROM CAST(s.{c} AS VARCHAR)"
    for i, c in enumerate(_TE)))

SQL["complaint_target_encoding"] = with_fixtures(LIFE_FIX, HIST + [
    ("tr", "SELECT *, CAST(target_rul AS DOUBLE) AS target FROM hsplit WHERE is_train"),
    ("prior", "SELECT avg(target) AS prior FROM tr"),
    ("st", "SELECT col, val, count(*) AS n, avg(target) AS mean FROM ("
           + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS val, target FROM tr"
                                for c in _TE) + ") GROUP BY col, val"),
    ("enc", f"""SELECT col, val, CASE WHEN n = 1 THEN prior
                  ELSE prior * (1{D} - w) + mean * w END AS enc
                FROM (SELECT st.*, p.prior, 1{D} / (1{D} + exp(-(n - 20) / 10{D})) AS w
                      FROM st, prior p)"""),
], "SELECT s.id, s.row_seq, s.is_train, round(ln(1 + biaya_perbaikan), 6) AS biaya_log, " + ", ".join(
    f"round(coalesce(e{i}.enc, (SELECT prior FROM prior)), 6) AS te_{c}" for i, c in enumerate(_TE))
   + " FROM hsplit s " + " ".join(
    f"LEFT JOIN enc e{i} ON e{i}.col = '{c}' AND e{i}.val IS NOT DISTINCT FROM CAST(s.{c} AS VARCHAR)"
    for i, c in enumerate(_TE)))

SQL["worst_predictions"] = with_fixtures(LIFE_FIX, ASSET, """
SELECT t.id, t.actual, t.predicted, t.error, a.kategori, a.sub_kategori, a.tipe, a.merek
FROM (SELECT id, actual, predicted, error FROM tpred ORDER BY error DESC, id LIMIT 15) t
LEFT JOIN assets a ON t.id = a.id""")

SQL["type_slice_error"] = with_fixtures(LIFE_FIX, ASSET, """
SELECT 'gear' AS tipe, count(*) AS n, round(avg(error), 6) AS mae FROM tpred
WHERE id IN (SELECT id FROM assets WHERE tipe = 'gear')""")

SQL["diverse_sample"] = with_fixtures(LIFE_FIX, ASSET + [
    ("test", "SELECT * FROM asplit WHERE NOT is_train"),
    ("firsts", """SELECT id, kategori, sub_kategori, tipe FROM (
                    SELECT *, row_number() OVER (PARTITION BY kategori, sub_kategori, tipe
                                                 ORDER BY tanggal_penggantian, id) AS rn FROM test)
                  WHERE rn = 1"""),
    ("cands", """SELECT id, kategori, sub_kategori, tipe, 'unique' AS pick FROM firsts
                UNION ALL SELECT id, kategori, sub_kategori, tipe, 'topup' FROM test
                WHERE id NOT IN (SELECT id FROM firsts)"""),
], """SELECT id, kategori, sub_kategori, tipe, pick FROM cands
      ORDER BY pick <> 'unique', md5(id || '|42') LIMIT 100""")

SQL["regression_metrics"] = with_fixtures(LIFE_FIX, ASSET, f"""
SELECT count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
       round(1{D} - sum((actual - predicted) * (actual - predicted)) / (count(*) * var_pop(actual)), 6) AS r2,
       round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16{D})), 6) AS mape,
       round(1{D} - var_pop(actual - predicted) / var_pop(actual), 6) AS explained_variance,
       round(max(abs(actual - predicted)), 6) AS max_error,
       round(median(abs(actual - predicted)), 6) AS medae
FROM tpred""")


# --- profiles and interval encoders ----------------------------------------------------------
FAN = COND + [("fan", """SELECT c.id, c.kategori, c.sub_kategori, c.tipe, c.tingkat_kekritisan,
        c.jumlah_komplain, c.rata_severity, s.frekuensi FROM cond c JOIN schedule s
        ON c.kategori IS NOT DISTINCT FROM s.kategori AND c.sub_kategori IS NOT DISTINCT FROM
           s.sub_kategori AND c.tipe IS NOT DISTINCT FROM s.tipe WHERE s.frekuensi IS NOT NULL""")]
INT_FIX = ["assets", "complaints", "schedule"]


def _describe(col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT '{col}' AS \"column\", count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM fan")


SQL["severity_describe"] = with_fixtures(
    INT_FIX, FAN, _describe("jumlah_komplain") + " UNION ALL " + _describe("rata_severity"))

SQL["complaint_boxplot"] = with_fixtures(INT_FIX, FAN + [
    ("lng", """SELECT frekuensi, 'jumlah_komplain' AS measure, CAST(jumlah_komplain AS DOUBLE) AS v
               FROM fan UNION ALL SELECT frekuensi, 'rata_severity', rata_severity FROM fan"""),
    ("qs", """SELECT frekuensi, measure, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                     quantile_cont(v, 0.75) AS q3 FROM lng
              WHERE frekuensi IS NOT NULL AND v IS NOT NULL GROUP BY ALL"""),
], """SELECT q.frekuensi, q.measure, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(v) FILTER (WHERE v >= q1 - (q3 - q1) * 1.5), 6) AS whisker_lo,
       round(max(v) FILTER (WHERE v <= q3 + (q3 - q1) * 1.5), 6) AS whisker_hi,
       count(*) FILTER (WHERE v < q1 - (q3 - q1) * 1.5 OR v > q3 + (q3 - q1) * 1.5) AS n_outliers
FROM lng l JOIN qs q ON l.frekuensi = q.frekuensi AND l.measure = q.measure
WHERE l.v IS NOT NULL GROUP BY q.frekuensi, q.measure, q1, median, q3""")

SQL["criticality_crosstab"] = with_fixtures(INT_FIX, FAN, """
SELECT tingkat_kekritisan, frekuensi, count(*) AS n FROM fan
WHERE tingkat_kekritisan IS NOT NULL AND frekuensi IS NOT NULL GROUP BY ALL""")

_ASSET_COLS = ["id", "nama", "kategori", "sub_kategori", "tipe", "merek", "tingkat_kekritisan",
               "tanggal_instalasi", "lokasi_gedung", "lokasi_lantai", "lokasi_zona", "row_seq"]
SQL["table_profile"] = with_fixtures(["assets"], [], " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", "
    f"'{'bigint' if c == 'row_seq' else 'string'}' AS data_type, count({c}) AS non_null, "
    f"count(*) AS n_rows FROM assets" for i, c in enumerate(_ASSET_COLS)))

_LC = ["kategori", "sub_kategori", "tipe", "tingkat_kekritisan", "frekuensi"]
SQL["label_encoding"] = with_fixtures(INT_FIX, ASSIGN, "SELECT id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Unknown')) - 1 AS BIGINT) AS {c}_code"
    for c in _LC) + " FROM assigned WHERE frekuensi IS NOT NULL")

STRAT = ASSIGN + [("strat", """SELECT *, rn > (2 * nc + 5) // 10 AS is_train FROM (
    SELECT *, row_number() OVER (PARTITION BY frekuensi ORDER BY md5(id || '|42'), id) AS rn,
              count(*) OVER (PARTITION BY frekuensi) AS nc
    FROM assigned WHERE frekuensi IS NOT NULL)""")]
SQL["stratified_split"] = with_fixtures(INT_FIX, STRAT, "SELECT id, frekuensi, is_train FROM strat")

SQL["classification_report"] = with_fixtures(INT_FIX, STRAT + [
    ("p0", f"""SELECT id, intervals,
        (least(jumlah_komplain / 10{D}, 1{D}) * 0.30{D} + (rata_severity / 4{D}) * 0.30{D})
          + {CRIT_W} * 0.20{D} AS u0 FROM scored"""),
    ("pred", """SELECT id, CASE WHEN intervals IS NULL OR len(intervals) = 0 THEN NULL
             WHEN len(intervals) = 1 THEN intervals[1]
             ELSE intervals[1 + least(greatest(CAST(trunc((1::DOUBLE - u0) * (len(intervals) - 1))
                  AS INTEGER), 0), len(intervals) - 1)] END AS predicted FROM p0"""),
    ("test", """SELECT s.frekuensi, p.predicted FROM strat s JOIN pred p ON s.id = p.id
                WHERE NOT s.is_train"""),
    ("per", """SELECT label, sum(support) AS support, sum(npred) AS npred, sum(tp) AS tp FROM (
                 SELECT frekuensi AS label, 1 AS support, 0 AS npred,
                        CASE WHEN frekuensi = predicted THEN 1 ELSE 0 END AS tp FROM test
                 UNION ALL SELECT predicted, 0, 1, 0 FROM test) WHERE label IS NOT NULL GROUP BY label"""),
    ("m", """SELECT label, support, tp, CASE WHEN npred = 0 THEN 0 ELSE tp / npred END AS precision,
                    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM per"""),
    ("m2", """SELECT *, CASE WHEN precision + recall = 0 THEN 0
                            ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m"""),
], """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
          CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
          CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
          round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
          CAST(sum(support) AS BIGINT) FROM m2""")


# --- tickets -----------------------------------------------------------------------------------
# blanks of Python's str.split(), by code point
WS = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex({strip_sql(x)}, '{WS}+'), lambda t: t <> '')"


def word_map_sql(var: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items()))
    return f"CASE {var} {arms} ELSE {var} END"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TICK = [
    ("trows", """SELECT * FROM tickets
        WHERE NOT (teks_keluhan_awam IS NULL AND teks_laporan_teknisi IS NULL)
          AND NOT contains(lower(coalesce(teks_keluhan_awam, 'nan')), 'teks_keluhan')
"""),
    ("tin", """SELECT *, coalesce(teks_keluhan_awam, 'nan') || ' ' || coalesce(teks_laporan_teknisi, 'nan')
                 AS input_teks FROM trows"""),
    ("tclean", f"""SELECT *, {collapse_sql(f"regexp_replace(lower(input_teks), '[^a-z{WS[1:-1]}]', '', 'g')")}
                     AS clean_strict FROM tin"""),
    ("tteks", f"""SELECT *, array_to_string(list_transform(list_filter({tokens_sql('clean_strict')},
                     lambda t: NOT list_contains({_STOP}, t)), lambda t: {word_map_sql('t', LEMMAS)}), ' ')
                     AS clean_teks FROM tclean"""),
    ("tsplit", f"""SELECT *, {u_sql(key_sql('ticket_id'))} < 0.8{D} AS is_train FROM tteks"""),
]
_BASIC = f"regexp_replace(lower(input_teks), '[^a-z0-9{WS[1:-1]}]', ' ', 'g')"

SQL["ticket_concat"] = with_fixtures(["tickets"], TICK, """
SELECT ticket_id, input_teks, kategori_aset, severity, root_cause, tindakan FROM tin""")

SQL["ticket_clean_basic"] = with_fixtures(["tickets"], TICK, f"""
SELECT ticket_id, {strip_sql(_BASIC)} AS clean_basic, {collapse_sql(_BASIC)} AS clean_collapsed FROM tin""")

SQL["ticket_clean_strict"] = with_fixtures(["tickets"], TICK, "SELECT ticket_id, clean_strict FROM tclean")

SQL["ticket_stop_lemma"] = with_fixtures(["tickets"], TICK, "SELECT ticket_id, clean_teks FROM tteks")

SQL["hash_split"] = with_fixtures(["tickets"], TICK, "SELECT ticket_id, is_train FROM tsplit")

SQL["ticket_synonym_augment"] = with_fixtures(["tickets"], TICK, f"""
SELECT ticket_id, 0 AS copy, clean_teks AS text, kategori_aset, severity, root_cause, tindakan
FROM tsplit WHERE is_train
UNION ALL
SELECT ticket_id, 1, array_to_string(list_transform({tokens_sql('clean_teks')},
                                                    lambda t: {word_map_sql('t', SYNONYMS)}), ' '),
       kategori_aset, severity, root_cause, tindakan
FROM tsplit WHERE is_train""")

_TOKU = u_sql("concat_ws('|', CAST(ticket_id AS VARCHAR), CAST(i - 1 AS VARCHAR), '42')")
SQL["ticket_partial_substitution"] = with_fixtures(["tickets"], TICK + [
    ("tb", f"SELECT ticket_id, {collapse_sql(_BASIC)} AS basic FROM tsplit WHERE is_train")], f"""
SELECT ticket_id, 0 AS copy, basic AS text FROM tb
UNION ALL
SELECT ticket_id, 1, array_to_string(list_transform({tokens_sql('basic')}, lambda t, i:
         CASE WHEN {_TOKU} < 0.2{D} THEN {word_map_sql('t', LEXICON)} ELSE t END), ' ') FROM tb""")

SQL["ticket_tfidf"] = with_fixtures(["tickets"], TICK + [
    ("docs", f"""SELECT ticket_id AS doc, is_train, list_filter({tokens_sql('clean_teks')}, lambda t: length(t) >= 2)
                  AS toks FROM tsplit"""),
    ("grams", """SELECT doc, is_train, list_concat(toks, list_transform(range(1, len(toks)),
                   lambda i: toks[i] || ' ' || toks[i + 1])) AS g FROM docs"""),
    ("tf", "SELECT doc, is_train, term, count(*) AS tf FROM (SELECT doc, is_train, unnest(g) AS term FROM grams) GROUP BY ALL"),
    ("pt", "SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE is_train GROUP BY term"),
    ("vocab", "SELECT term, df FROM pt ORDER BY cf DESC, term LIMIT 2000"),
    ("w", """SELECT tf.doc, tf.term,
                    tf.tf * (ln((1 + (SELECT count(*) FROM docs WHERE is_train)) / (1 + vocab.df)) + 1) AS w
             FROM tf JOIN vocab ON tf.term = vocab.term"""),
], "SELECT doc AS ticket_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS tfidf FROM w")

_TG = ["kategori_aset", "severity", "root_cause", "tindakan"]
SQL["exact_match"] = with_fixtures(["tickets"], TICK + [
    ("whole", """SELECT * FROM tsplit WHERE kategori_aset IS NOT NULL AND severity IS NOT NULL
                 AND root_cause IS NOT NULL AND tindakan IS NOT NULL"""),
    ("tr", "SELECT * FROM whole WHERE is_train"),
    ("te", "SELECT * FROM whole WHERE NOT is_train"),
    ("maj", "SELECT " + ", ".join(
        f"(SELECT {c} FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m_{c}" for c in _TG)),
], "SELECT count(*) AS n, round(avg(CASE WHEN " + " AND ".join(f"{c} = m_{c}" for c in _TG)
   + f" THEN 1{D} ELSE 0{D} END), 6) AS exact_match, "
   + ", ".join(f"round(avg(CASE WHEN {c} = m_{c} THEN 1{D} ELSE 0{D} END), 6) AS acc_{c}" for c in _TG)
   + " FROM te, maj")


# --- corpus jobs -----------------------------------------------------------------------------
_COMBO = ["kategori", "sub_kategori", "tipe", "merek", "lokasi_gedung", "lokasi_lantai", "lokasi_zona"]
_CASE = ["kategori", "severity", "penyebab", "jenis_kerusakan"]


def _cat_sql(table: str, cols: list[str], source: str) -> str:
    inner = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS val FROM {table}" for c in cols)
    return (f"SELECT '{source}' AS source, col AS \"column\", val AS value, count(*) AS n "
            f"FROM ({inner}) WHERE val IS NOT NULL GROUP BY col, val")


SQL["allowed_values"] = with_fixtures(["assets", "complaints"], [], _cat_sql(
    "complaints", ["severity", "penyebab", "jenis_kerusakan"], "complaints") + " UNION ALL "
    + _cat_sql("assets", _COMBO, "assets"))

_COMBOS = ("combos0", "SELECT DISTINCT " + ", ".join(_COMBO) + " FROM assets WHERE "
           + " AND ".join(f"{c} IS NOT NULL" for c in _COMBO))
SQL["valid_combinations"] = with_fixtures(["assets"], [_COMBOS], "SELECT * FROM combos0")
SQL["combination_sample"] = with_fixtures(["assets"], [_COMBOS], "SELECT * FROM combos0 ORDER BY md5(concat_ws('|', "
                                          + ", ".join(_COMBO) + ", '42')) LIMIT 3")

_CKEY = "concat_ws('|', " + ", ".join(f"coalesce(c.{c}, 'nan')" for c in _CASE) + ", '42')"
QUEUE = [
    _COMBOS,
    ("cases", f"""SELECT {', '.join(_CASE)}, biaya_perbaikan FROM (
        SELECT *, row_number() OVER (PARTITION BY {', '.join(_CASE)} ORDER BY id, row_seq) AS rn
        FROM complaints) WHERE rn = 1"""),
    ("combos", f"""SELECT *, row_number() OVER (PARTITION BY kategori ORDER BY {', '.join(_COMBO[1:])}) AS pick,
                          count(*) OVER (PARTITION BY kategori) AS n_cat FROM combos0"""),
    ("drawn", f"""SELECT c.*, CAST(floor({u_sql(_CKEY)} * n.n_cat) + 1 AS BIGINT) AS pick
                  FROM cases c JOIN (SELECT DISTINCT kategori, n_cat FROM combos) n
                  ON c.kategori = n.kategori"""),
    ("queue", """SELECT d.kategori, k.tipe, k.merek, k.lokasi_gedung, k.lokasi_lantai, k.lokasi_zona,
                        d.severity, d.penyebab, d.jenis_kerusakan, d.biaya_perbaikan
                 FROM drawn d JOIN combos k ON d.kategori = k.kategori AND d.pick = k.pick"""),
    ("remaining", """SELECT * FROM queue q WHERE NOT EXISTS (SELECT 1 FROM done_cases d
        WHERE d.kategori_aset IS NOT DISTINCT FROM q.kategori AND d.severity IS NOT DISTINCT FROM q.severity
          AND d.root_cause IS NOT DISTINCT FROM q.penyebab
          AND d.jenis_kerusakan IS NOT DISTINCT FROM q.jenis_kerusakan)"""),
]
SQL["coverage_queue"] = with_fixtures(["assets", "complaints"], QUEUE[:-1], "SELECT * FROM queue")
SQL["queue_remaining"] = with_fixtures(["assets", "complaints", "done_cases"], QUEUE,
                                       "SELECT * FROM remaining")

PROMPT = ("Tugas: tulis tiga tiket perbaikan sebagai baris berpemisah pipa.\n"
          "kategori=%s\ntipe=%s\nmerek=%s\ngedung=%s\nlantai=%s\nzona=%s\nseverity=%s\n"
          "penyebab=%s\nkerusakan=%s\nbiaya=%s\n"
          "Nilai di atas dipakai persis. Urutan kolom: teks_keluhan_awam|teks_laporan_teknisi|"
          "kategori_aset|severity|root_cause|jenis_kerusakan|biaya_perbaikan")

SQL["prompt_text"] = with_fixtures(["assets", "complaints", "done_cases"], QUEUE, f"""
SELECT kategori, severity, penyebab, jenis_kerusakan,
       printf('{PROMPT}', kategori, tipe, merek, lokasi_gedung, lokasi_lantai, lokasi_zona,
              severity, penyebab, jenis_kerusakan,
              CAST(CAST(round(biaya_perbaikan) AS BIGINT) AS VARCHAR)) AS prompt
FROM remaining""")

_V2 = ["teks_keluhan_awam", "teks_laporan_teknisi", "kategori_aset", "severity", "root_cause",
       "jenis_kerusakan", "biaya_perbaikan"]
_FENCED = strip_sql("replace(replace(response_text, '```csv', ''), '```', '')")
RESP = [
    ("txt", f"""SELECT batch_id, CASE WHEN starts_with(lower(t0), 'teks_keluhan')
                     THEN array_to_string(string_split(t0, chr(10))[2:], chr(10)) ELSE t0 END AS t
                FROM (SELECT batch_id, {_FENCED} AS t0 FROM responses)"""),
    ("lines", """SELECT batch_id, unnest(string_split(t, chr(10))) AS line,
                        unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM txt"""),
    ("kept", f"SELECT *, string_split(line, '|') AS f FROM lines WHERE {strip_sql('line')} <> ''"),
    ("rrows", "SELECT batch_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(f) AS BIGINT) AS n_fields, "
              + ", ".join(f"f[{i + 1}] AS {c}" for i, c in enumerate(_V2)) + " FROM kept WHERE len(f) <= 7"),
]
SQL["response_rows"] = with_fixtures(["assets", "complaints", "responses"], RESP, """
SELECT r.*, coalesce(r.severity IN (SELECT severity FROM complaints WHERE severity IS NOT NULL), false)
       AS severity_known FROM rrows r""")

_ASKED = [("kategori_aset", "kategori"), ("severity", "severity"), ("root_cause", "penyebab"),
          ("jenis_kerusakan", "jenis_kerusakan"), ("biaya_perbaikan", "money")]
_SAME = [(f, f"nullif({strip_sql('r.' + f)}, '') IS NOT DISTINCT FROM a.{c}") for f, c in _ASKED]
SQL["response_conformance"] = with_fixtures(["assets", "complaints", "responses"], QUEUE[:-1] + RESP, f"""
SELECT r.batch_id, r.line_no, {', '.join('r.' + f for f, _ in _ASKED)},
       CASE WHEN a.b IS NULL THEN 0 ELSE {' + '.join(f'CAST({x} AS BIGINT)' for _, x in _SAME)} END AS matched,
       a.b IS NOT NULL AND {' AND '.join(f'({x})' for _, x in _SAME)} AS conforms,
       CASE WHEN a.b IS NULL THEN 'no case' ELSE
         nullif(concat_ws(',', {', '.join(f"CASE WHEN NOT ({x}) THEN '{f}' END" for f, x in _SAME)}), '') END AS reason
FROM rrows r LEFT JOIN (
  SELECT row_number() OVER (ORDER BY md5(concat_ws('|', coalesce(kategori, 'nan'), coalesce(severity, 'nan'), coalesce(penyebab, 'nan'),
           coalesce(jenis_kerusakan, 'nan'), '42')), kategori, severity, penyebab, jenis_kerusakan) - 1 AS b,
         kategori, severity, penyebab, jenis_kerusakan, CAST(CAST(round(biaya_perbaikan) AS BIGINT) AS VARCHAR) AS money
  FROM queue) a ON a.b = r.batch_id""")

SQL["ticket_read_bad_lines"] = with_fixtures(["responses"], RESP, """
SELECT n_fields, count(*) AS n_rows, count(DISTINCT batch_id) AS n_batches FROM rrows GROUP BY 1""")

SQL["delimiter_sniff"] = with_fixtures(["responses"], [], """
SELECT batch_id, CASE WHEN contains(split_part(response_text, chr(10), 1), '|') THEN '|' ELSE ',' END AS sep
FROM responses""")


# --- reports --------------------------------------------------------------------------------
TAG_PATTERN = r"(\[[A-Z_]+\])\s*([^\[]+)"
REPORT_CHARSET = r"[^\p{L}\p{N}_" + WS[1:-1] + r"\.,!?\-Rp\[\]\|]"
from upkeep.oracle.fixtures_sql import dots  # noqa: E402


def clean_report_sql(x: str) -> str:
    body = strip_sql(f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '{REPORT_CHARSET}', '', 'g')")
    return f"CASE WHEN {x} IS NULL THEN '' ELSE {body} END"


TAGS = [
    ("tp", f"""SELECT pair_id, linearized_data_input, narasi_laporan_output,
                      regexp_extract_all(linearized_data_input, '{TAG_PATTERN}', 1) AS tags,
                      regexp_extract_all(linearized_data_input, '{TAG_PATTERN}', 2) AS vals
               FROM report_pairs"""),
    ("perm", f"""SELECT pair_id, narasi_laporan_output,
        CASE WHEN linearized_data_input IS NULL THEN NULL
             WHEN len(tags) = 0 THEN linearized_data_input
             ELSE array_to_string(list_transform(list_sort(list_transform(range(1, len(tags) + 1),
                    lambda i: struct_pack(h := md5(concat_ws('|', tags[i], CAST(pair_id AS VARCHAR), '42')),
                                          t := tags[i] || ' ' || {strip_sql('vals[i]')}))),
                  lambda x: x.t), ' ') END AS permuted FROM tp"""),
]
SQL["tagged_parse"] = with_fixtures(["report_pairs"], TAGS, f"""
SELECT pair_id, CAST(i - 1 AS BIGINT) AS pos, tags[i] AS tag, {strip_sql('vals[i]')} AS value
FROM (SELECT pair_id, tags, vals, unnest(range(1, len(tags) + 1)) AS i FROM tp)""")

SQL["tagged_permute"] = with_fixtures(["report_pairs"], TAGS, "SELECT pair_id, permuted FROM perm")

SQL["report_pairs"] = with_fixtures(["report_pairs"], TAGS + [
    ("aug", """SELECT DISTINCT linearized_data_input, narasi_laporan_output FROM (
                 SELECT linearized_data_input, narasi_laporan_output FROM report_pairs
                 UNION ALL SELECT permuted, narasi_laporan_output FROM perm)""")], f"""
SELECT 'Buat laporan: ' || {clean_report_sql('linearized_data_input')} AS clean_input,
       {clean_report_sql('narasi_laporan_output')} AS clean_output FROM aug""")


def _ids_sql(col: str, pad: int) -> str:
    return f"""(SELECT pp.pair_key, len({tokens_sql(col)}) AS n, coalesce(x.ids, []) AS ids
               FROM pp LEFT JOIN (SELECT pair_key, list(coalesce(v.id, 2) ORDER BY pos) AS ids
                 FROM (SELECT pair_key, unnest({tokens_sql(col)}) AS token,
                              unnest(range(len({tokens_sql(col)}))) AS pos FROM pp) t
                 LEFT JOIN vocab v ON t.token = v.token GROUP BY pair_key) x ON pp.pair_key = x.pair_key)"""


def _pad_sql(ids: str, pad: int) -> str:
    full = f"list_concat({ids}[1:127], [1])"
    return f"array_to_string(list_concat({full}, list_transform(range(128 - len({full})), lambda i: {pad})), ',')"


SQL["fixed_length_ids"] = with_fixtures(["report_pairs"], TAGS + [
    ("aug", """SELECT DISTINCT linearized_data_input, narasi_laporan_output FROM (
                 SELECT linearized_data_input, narasi_laporan_output FROM report_pairs
                 UNION ALL SELECT permuted, narasi_laporan_output FROM perm)"""),
    ("pp", f"""SELECT md5(concat_ws('|', coalesce(linearized_data_input, ''), narasi_laporan_output)) AS pair_key,
                      'Buat laporan: ' || {clean_report_sql('linearized_data_input')} AS src,
                      {clean_report_sql('narasi_laporan_output')} AS tgt FROM aug"""),
    ("words", f"SELECT unnest(list_concat({tokens_sql('src')}, {tokens_sql('tgt')})) AS token FROM pp"),
    ("vocab", """SELECT token, CAST(row_number() OVER (ORDER BY c DESC, token) + 2 AS INTEGER) AS id
                 FROM (SELECT token, count(*) AS c FROM words GROUP BY token ORDER BY c DESC, token LIMIT 32000)"""),
    ("si", _ids_sql("src", 0)),
    ("ti", _ids_sql("tgt", -100)),
], f"""SELECT si.pair_key, si.n AS n_input_tokens, {_pad_sql('si.ids', 0)} AS input_ids,
              ti.n AS n_label_tokens, {_pad_sql('ti.ids', -100)} AS labels
       FROM si JOIN ti ON si.pair_key = ti.pair_key""")

_SEVW = "CASE severity_max WHEN 1 THEN 'Ringan' WHEN 2 THEN 'Sedang' WHEN 3 THEN 'Berat' WHEN 4 THEN 'Fatal' ELSE 'Tidak Ada' END"
REP = ASSET + [("rep", f"""SELECT l.id, a.nama,
        CAST(greatest(coalesce(round_even(2950{D} - total_komplain * 75 - severity_max * 240, 0)
                                - datediff('day', l.inst, DATE '2002-01-01'),
                               round_even(2950{D} - total_komplain * 75 - severity_max * 240, 0)), 1{D}) AS BIGINT)
          AS days_left,
        {_SEVW} AS severity_word, CAST(round(biaya_mean) AS BIGINT) AS money
        FROM lab l LEFT JOIN assets a ON l.id = a.id""")]
SQL["linearize_asset"] = with_fixtures(LIFE_FIX, REP, f"""
SELECT id, '[MESIN] ' || nama || ' [STATUS] Prediksi Rusak ' || CAST(days_left AS VARCHAR)
           || ' Hari [SEVERITY] ' || severity_word || ' [ESTIMASI_BIAYA] Rp ' || {dots('money')}
           AS linearized_data_input FROM rep""")
SQL["asset_report_text"] = with_fixtures(LIFE_FIX, REP, f"""
SELECT id, printf('%s: sisa umur %s hari, keparahan tertinggi %s, biaya rata-rata Rp %s', nama, CAST(days_left AS VARCHAR), severity_word, {dots('money')})
       AS report FROM rep""")
