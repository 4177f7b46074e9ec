"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from upkeep.llm import (bpe, decontaminate, line_dedup, negatives, pii, quality, quotes, runs, secrets,
                        simhash, token_files, toxicity, warc)

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quotation_linking": quotes.op4_quotation_linking,
    "op5_token_files": token_files.op5_token_files,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "quality_ablation": quality.quality_ablation,
    "op11_warc": warc.op11_warc,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

SQL: dict[str, str] = {}

# Rules in bit order, written out again.
SQL["op10_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
             len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '\p{L}')) AS n_letters,
             len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(regexp_extract_all(text, '[!?]')) AS n_marks
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
             + 64 * (n_letters >= 20 AND 2 * n_upper > n_letters)::BIGINT + 128 * (2 * n_letters < word_chars)::BIGINT
             + 256 * (5 * n_digits > word_chars)::BIGINT + 512 * (4 * n_marks > n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b"""

_POLICIES = [("base", 1, 3), ("corpus", 1, 255), ("corpus", 2, 1023)]
_RULES = ["few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "shouting",
          "few_letters", "digits", "shouted_marks"]
SQL["quality_ablation"] = f"""
WITH led AS (SELECT fail_bits AS b FROM ({SQL["op10_quality_rules"]})),
pol(policy, version, mask) AS (VALUES {', '.join(f"('{n}', {v}, {m})" for n, v, m in _POLICIES)}),
rul(rule, bit) AS (VALUES {', '.join(f"('{r}', {1 << i})" for i, r in enumerate(_RULES))})
SELECT policy, version, rule, (SELECT count(*) FROM led WHERE b & mask = 0) AS n_kept,
       (SELECT count(*) FROM led WHERE b & bit <> 0) AS n_failed, (SELECT count(*) FROM led WHERE b & mask = bit) AS n_only_this
FROM pol JOIN rul ON mask & bit <> 0"""

# A line has a neighbour one edit away if the two agree up to some place and after it; such lines
# share their first or their last half (of the shorter one).
SQL["op9_line_dedup"] = r"""
WITH l AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, regexp_matches(line, '[^ \t-\r]') AS written
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        unnest(range(len(string_split(text, chr(10))))) AS line_no
                 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))),
f AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) AS pos, doc_id, line_no
      FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS rn FROM l WHERE written)
      WHERE rn = 1),
c AS (SELECT *, length(line) AS n FROM f WHERE length(line) >= 20),
k AS (SELECT line, pos, n, h, 'p' || left(line, h // 2) AS key FROM (SELECT *, unnest([n, n - 1]) AS h FROM c)
      UNION ALL
      SELECT line, pos, n, h, 's' || right(line, h - h // 2) FROM (SELECT *, unnest([n, n - 1]) AS h FROM c)),
p AS (SELECT DISTINCT a.line AS line, a.n AS n, b.line AS other, b.n AS m FROM k a JOIN k b
      ON a.key = b.key AND a.h = b.h AND b.pos < a.pos AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT line FROM p WHERE len(list_filter(range(least(n, m) + 1), lambda i:
           left(line, i) = left(other, i)
           AND right(line, greatest(n - i - (n >= m)::BIGINT, 0)) = right(other, greatest(m - i - (m >= n)::BIGINT, 0)))) > 0),
kept AS (SELECT doc_id, line_no FROM f WHERE line NOT IN (SELECT line FROM near)),
o AS (SELECT l.doc_id, l.line_no, l.line, l.written, (NOT l.written OR kept.doc_id IS NOT NULL) AS stays
      FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id AND l.line_no = kept.line_no)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       count(*) FILTER (WHERE written AND stays) AS n_left,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stays), '')) AS kept_md5
FROM o GROUP BY doc_id"""

# Offsets are the lengths of what lies between the matches and of the matches before.
_KINDS = [
    ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, "[0-9a-f]{16,}", 0, 16),
    ("live", 3, "[A-Za-z0-9+/_=-]{12,}", 0, 12),
]
_FOUND = " UNION ALL ".join(f"""
SELECT doc_id, owner, '{kind}' AS kind, {rank} AS ord, vs[i] AS value,
       coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS size
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, owner, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS gs,
               regexp_extract_all(text, '{rx}', {group}) AS vs FROM t))
WHERE length(vs[i]) >= {least}""" for kind, rank, rx, group, least in _KINDS)

SQL["op7_secret_scan"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
f0 AS ({_FOUND}),
f AS (SELECT *, s + size AS e FROM f0
      WHERE ord < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))),
v AS (SELECT value, count(DISTINCT owner) >= 3 OR count(DISTINCT (owner, doc_id)) >= 10 AS copied, bool_or(ord < 3) AS named
      FROM f GROUP BY value),
j AS (SELECT f.*, v.copied, v.named,
             exists(SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.ord < 3 AND b.s < f.e AND f.s < b.e) AS covered
      FROM f JOIN v ON f.value = v.value),
k AS (SELECT *, kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS written FROM j
      WHERE ord < 3 OR (NOT covered AND NOT copied AND (named OR (length(value) >= 20
        AND len(list_distinct(string_split(value, ''))) >= 10)))),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(written, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base,
             string_agg(written, ',' ORDER BY s, ord) AS spans, count(*) FILTER (WHERE NOT copied) AS n_live,
             count(*) FILTER (WHERE copied) AS n_example FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""

# The same rules with a recursive chain of answers.
_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQL["op4_quotation_linking"] = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l0 AS (SELECT conv_id, turn, i, x, length(regexp_replace(regexp_extract(x, '^ ?>[> ]*', 0), '[^>]', '', 'g')) AS level,
              regexp_replace(x, '^ ?>[> ]*', '') AS body
       FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x,
                    unnest(range(len(string_split(text, chr(10))))) AS i FROM m)),
l AS (SELECT * EXCLUDE (level), CASE WHEN level = 0 AND coalesce(lead(level) OVER w, 0) > 0
               AND regexp_matches(body, '^On .* wrote:\s*$') THEN -1 ELSE level END AS level
      FROM l0 WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
own AS (SELECT conv_id, turn, trim(string_agg(body, chr(10) ORDER BY i), E' \t\r\n') AS text
        FROM l WHERE level = 0 GROUP BY ALL),
q0 AS (SELECT *, sum(step) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM (
         SELECT *, CASE WHEN level > 0 AND level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i)
                        THEN 1 ELSE 0 END AS step FROM l)),
q AS (SELECT conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS text FROM q0 WHERE level > 0 GROUP BY ALL),
ok AS (SELECT conv_id, turn, {_NORM.format('text')} AS key FROM own
       UNION SELECT conv_id, turn, key FROM (SELECT conv_id, turn, {_NORM.format('x')} AS key
         FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM own))
       WHERE len(string_split(key, ' ')) >= 3),
inconv AS (SELECT conv_id, key, min(turn) AS turn FROM ok WHERE key <> '' GROUP BY ALL),
qk AS (SELECT conv_id, turn, run, level, {_NORM.format('text')} AS key, 0 AS rank FROM q
       UNION ALL SELECT * FROM (SELECT conv_id, turn, run, level, {_NORM.format('x')} AS key, 1 AS rank
         FROM (SELECT conv_id, turn, run, level, unnest(string_split(text, chr(10))) AS x FROM q))
       WHERE len(string_split(key, ' ')) >= 3),
elsewhere AS (SELECT k.conv_id, k.key, min(b.conv_id) AS sc, arg_min(b.turn, b.conv_id) AS st
              FROM (SELECT DISTINCT conv_id, key FROM qk) k JOIN inconv b ON b.key = k.key AND b.conv_id <> k.conv_id GROUP BY ALL),
met AS (SELECT qk.*, CASE WHEN a.turn < qk.turn THEN a.conv_id ELSE b.sc END AS sc,
               CASE WHEN a.turn < qk.turn THEN a.turn ELSE b.st END AS st
        FROM qk LEFT JOIN inconv a ON a.conv_id = qk.conv_id AND a.key = qk.key
        LEFT JOIN elsewhere b ON b.conv_id = qk.conv_id AND b.key = qk.key
        WHERE qk.key <> ''),
best AS (SELECT conv_id, turn, run, level, sc, st FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, run
           ORDER BY sc <> conv_id, rank, sc, st) AS rn FROM met WHERE st IS NOT NULL) WHERE rn = 1),
link AS (SELECT conv_id, turn, count(*) AS n_linked, max(CASE WHEN level = 1 AND sc = conv_id THEN st END) AS parent
         FROM best GROUP BY ALL),
chain AS (SELECT conv_id, turn, turn AS top, [turn] AS path FROM m
          UNION ALL SELECT c.conv_id, c.turn, k.parent, list_prepend(k.parent, c.path)
          FROM chain c JOIN link k ON k.conv_id = c.conv_id AND k.turn = c.top WHERE k.parent IS NOT NULL),
deep AS (SELECT conv_id, turn, arg_max(path, len(path)) AS path FROM chain GROUP BY ALL),
n AS (SELECT conv_id, turn, count(*) AS n FROM q GROUP BY ALL)
SELECT m.conv_id, m.turn, coalesce(n.n, 0) AS n_quotes, coalesce(link.n_linked, 0) AS n_linked, coalesce(link.parent, -1) AS parent_turn,
       deep.path[1] AS thread, CAST(len(deep.path) - 1 AS BIGINT) AS depth,
       array_to_string(deep.path, '/') AS path,
       md5('<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(own.text, '') || chr(10) || '<|end|>' || chr(10)) AS formatted_md5
FROM m LEFT JOIN own ON m.conv_id = own.conv_id AND m.turn = own.turn LEFT JOIN n ON m.conv_id = n.conv_id AND m.turn = n.turn
LEFT JOIN link ON m.conv_id = link.conv_id AND m.turn = link.turn LEFT JOIN deep ON m.conv_id = deep.conv_id AND m.turn = deep.turn"""

# Base 32 from 20 bits (five hex digits) at a time.
SQL["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t"""

SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 10"""
