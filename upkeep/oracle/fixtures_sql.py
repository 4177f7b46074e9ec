"""DuckDB versions of the fixture tables (FIXTURES.md part B), as CTE bodies.

Views ``part lineitem documents labels embeddings`` are registered by the caller.
"""

from __future__ import annotations

NL = "chr(10)"

_ID = "printf('A%06d', p_partkey)"
_PRICE = "CAST(round(p_retailprice * 1000) AS BIGINT)"
_REPORT_SEV = ("CASE p_size % 4 WHEN 0 THEN 'Rendah' WHEN 1 THEN 'Sedang' "
               "WHEN 2 THEN 'Tinggi' ELSE 'Kritis' END")


def _day(base: str, offset: str) -> str:
    return f"strftime(DATE '{base}' + CAST({offset} AS INTEGER), '%d-%m-%Y')"


def dots(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


CTES: dict[str, tuple[list[str], str]] = {
    "assets": ([], f"""
SELECT {_ID} AS id, p_name AS nama, p_type AS kategori,
       'Sub' || CAST(CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 3 AS VARCHAR) AS sub_kategori,
       split_part(p_name, ' ', 2) AS tipe, split_part(p_name, ' ', 1) AS merek,
       CASE p_size % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Major' WHEN 2 THEN 'Minor' END
         AS tingkat_kekritisan,
       CASE WHEN p_partkey % 50 = 0 THEN '00-00-0000'
            ELSE {_day('1988-01-01', '(p_partkey * 37) % 2400')} END AS tanggal_instalasi,
       'G' || CAST(p_size % 3 AS VARCHAR) AS lokasi_gedung,
       'L' || CAST(p_size % 5 AS VARCHAR) AS lokasi_lantai,
       'Z' || CAST(p_partkey % 4 AS VARCHAR) AS lokasi_zona,
       p_partkey AS row_seq
FROM part"""),
    "complaints": (["assets"], f"""
SELECT a.id, a.kategori, a.sub_kategori, a.tipe,
       CASE l_linenumber WHEN 1 THEN 'Ringan' WHEN 2 THEN 'Ringan' WHEN 3 THEN 'Sedang'
            WHEN 4 THEN 'Sedang' WHEN 5 THEN 'Berat' WHEN 6 THEN 'Fatal'
            WHEN 7 THEN 'Lainnya' END AS severity,
       CASE l_returnflag WHEN 'A' THEN 'Aus' WHEN 'N' THEN 'Tersumbat'
            WHEN 'R' THEN 'Konsleting' END AS penyebab,
       l_linestatus AS jenis_kerusakan, l_extendedprice AS biaya_perbaikan,
       strftime(CAST(l_shipdate AS DATE) - 3, '%d-%m-%Y') AS tanggal_perencanaan,
       CASE WHEN l_orderkey % 40 = 0 THEN NULL
            ELSE strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y') END AS tanggal_pengerjaan,
       strftime(CAST(l_shipdate AS DATE) + 2, '%d-%m-%Y') AS tanggal_selesai,
       datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * CAST(281474976710656 AS BIGINT)
         + l_orderkey * 8 + l_linenumber AS row_seq
FROM lineitem JOIN assets a ON a.row_seq = l_partkey
WHERE l_partkey % 10 <> 0"""),
    "schedule": (["assets"], """
SELECT kategori, sub_kategori, tipe,
       (['Harian', 'Mingguan', 'Bulanan', 'Tiga Bulanan', 'Semester', 'Tahunan', 'Reaktif'])[i]
         AS frekuensi,
       CAST(i AS BIGINT) AS row_seq
FROM (SELECT kategori, sub_kategori, tipe, unnest(range(1, 8)) AS i
      FROM (SELECT DISTINCT kategori, sub_kategori, tipe FROM assets))
WHERE (length(kategori) + length(tipe) + CAST(right(sub_kategori, 1) AS INTEGER) + i)
      % (2 + length(tipe) % 2) = 0 AND tipe <> 'rod'"""),
    "replacements": ([], f"""
SELECT {_ID} AS id, p_name AS nama,
       CASE WHEN p_partkey % 11 = 0 THEN NULL
            ELSE {_day('1999-01-01', '(p_partkey * 53) % 1400')} END AS tanggal_penggantian,
       CAST(0 AS BIGINT) AS row_seq
FROM part WHERE p_partkey % 3 <> 0
UNION ALL
SELECT {_ID}, p_name, {_day('2002-01-01', 'p_partkey % 90')}, CAST(1 AS BIGINT)
FROM part WHERE p_partkey % 7 = 0"""),
    "tickets": ([], f"""
SELECT d.doc_id AS ticket_id,
       CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE split_part(text, {NL}, 1) END
         AS teks_keluhan_awam,
       CASE WHEN d.doc_id % 23 = 0 OR d.doc_id % 29 = 0 THEN NULL
            ELSE nullif(substr(text, length(split_part(text, {NL}, 1)) + 2), '') END
         AS teks_laporan_teknisi,
       source AS kategori_aset, lang AS severity,
       'q' || CAST(quality AS VARCHAR) AS root_cause,
       CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE 't' || CAST(toxic AS VARCHAR) END AS tindakan
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "responses": ([], f"""
SELECT batch_id,
       CASE batch_id % 3
         WHEN 0 THEN '```csv' || {NL} || body || {NL} || '```'
         WHEN 1 THEN 'teks_keluhan_awam|teks_laporan_teknisi|kategori_aset|severity|root_cause|jenis_kerusakan|biaya_perbaikan' || {NL} || body
         ELSE body END AS response_text
FROM (SELECT p_partkey // 5 AS batch_id,
             string_agg('keluhan ' || p_name || '|laporan ' || p_brand || '|' || p_type || '|'
                        || {_REPORT_SEV} || '|Aus|' || p_name
                        || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '|' || CAST({_PRICE} AS VARCHAR) END
                        || CASE WHEN p_partkey % 13 = 0 THEN '|x' ELSE '' END,
                        {NL} ORDER BY p_partkey) AS body
      FROM part GROUP BY 1)"""),
    "report_pairs": ([], f"""
SELECT p_partkey AS pair_id,
       CASE WHEN p_partkey % 40 = 0 THEN NULL
            WHEN p_partkey % 41 = 0 THEN 'Catatan servis ' || p_name || ' tanpa tag'
            ELSE '[MESIN] ' || p_name || ' [STATUS] Prediksi Rusak '
                 || CAST(p_partkey % 30 + 1 AS VARCHAR) || ' Hari [SEVERITY] ' || {_REPORT_SEV}
                 || ' [ESTIMASI_BIAYA] Rp ' || {dots(_PRICE)} END AS linearized_data_input,
       'Aset ' || p_name || ' (' || p_brand || ') diprediksi rusak dalam '
         || CAST(p_partkey % 30 + 1 AS VARCHAR) || ' hari; siapkan dana Rp ' || {dots(_PRICE)}
         || '.' AS narasi_laporan_output
FROM part"""),
    "done_cases": (["complaints"], """
SELECT DISTINCT kategori AS kategori_aset, severity, penyebab AS root_cause, jenis_kerusakan
FROM complaints WHERE length(severity) % 2 = 0"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for dep in CTES[n][0]:
            visit(dep)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_fixtures(names: list[str], ctes: list[tuple[str, str]], final: str) -> str:
    """``WITH <fixtures>, <ctes> <final>``"""
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in _order(names)]
    parts += [f"{n} AS ({body}\n)" for n, body in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + final) if parts else final
