"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TAILS = r"/?s>|/?INST\]|</?SYS>>|<ROLE |</ROLE>>"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
     items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
     windows AS (SELECT DISTINCT item, w[i:i + least(13, len(w)) - 1] AS k, least(13, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM items WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT n FROM windows),
     places AS (SELECT doc_id, n, i, w[i:i + n - 1] AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN lengths WHERE len(w) >= n)),
     found AS (SELECT doc_id, places.n, i, item FROM places JOIN windows ON places.k = windows.k),
     hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM found) CROSS JOIN range(0, 13) AS t(j) WHERE j < n GROUP BY doc_id),
     named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op5_chat_format": rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     conflicts AS (SELECT *, regexp_matches(text, '[<\[]\\+({_TAILS})') OR (role = 'user' AND contains(text, ' [/INST]')) OR (role = 'assistant' AND contains(text, '</s>')) OR (role = 'system' AND contains(text, '<</SYS>>')) OR contains(text, '<</ROLE>>') AND role NOT IN ('user', 'assistant', 'system') AS conflict FROM turns),
     sized AS (SELECT *, length(text) + CASE WHEN conflict THEN len(regexp_extract_all(text, '[<\[]\\*({_TAILS})')) ELSE 0 END + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + 2 * strlen(role) END AS chars FROM conflicts)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, TRUE AS round_trip
FROM sized GROUP BY conv_id""",
    "op6_suffix_dedup": """
WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
     parts AS (SELECT rid, 4096 * k AS base, substr(h, 8192 * k + 1, 2 * (4096 + 199)) AS p FROM (SELECT rid, h, n, unnest(range(0, (n + 4095) // 4096)) AS k FROM docs)),
     windows AS (SELECT rid, base + i AS place, md5_number(substr(p, 2 * i + 1, 400)) AS w FROM (SELECT rid, base, p, unnest(range(0, least(4096, length(p) // 2 - 199))) AS i FROM parts WHERE length(p) >= 400)),
     twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
     hits AS (SELECT rid, place FROM windows SEMI JOIN twice USING (w)),
     starts AS (SELECT rid, place, CASE WHEN place - lag(place) OVER (PARTITION BY rid ORDER BY place) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits),
     runs AS (SELECT rid, min(place) AS a, max(place) + 200 AS b FROM (SELECT rid, place, sum(fresh) OVER (PARTITION BY rid ORDER BY place) AS g FROM starts) GROUP BY rid, g),
     gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS lo, a AS hi, b FROM runs),
     kept AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) || substr(any_value(h), 2 * max(b) + 1) AS rest, sum(b - hi) AS removed, count(*) AS spans FROM gaps JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)""",
    "op7_quality_rules": rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_PLAIN} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
     windows AS (SELECT doc_id, i, w[i:i + 7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
     repeated AS (SELECT doc_id, unnest(spots) AS i FROM (SELECT doc_id, list(i) AS spots FROM windows GROUP BY doc_id, k HAVING count(*) > 1)),
     covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated CROSS JOIN range(0, 8) AS t(j) GROUP BY doc_id),
     counts AS (SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                       len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM docs LEFT JOIN covered USING (doc_id)),
     judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
     failing AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines AS failed FROM judged),
     hosts AS (SELECT source, count(*) AS n, sum(CAST(failed AS BIGINT)) AS f FROM failing GROUP BY source),
     moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
     prior AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 10 END AS k FROM moments),
     verdicts AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS host_bad FROM hosts CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_bad AS kept
FROM failing JOIN verdicts ON failing.source IS NOT DISTINCT FROM verdicts.source""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     shingles AS (SELECT DISTINCT doc_id, w[i:i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM docs WHERE len(w) > 0)),
     sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * s >= 80 * (x.n + y.n - s)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach AS (SELECT doc_id AS d, doc_id AS c FROM docs UNION SELECT edges.b, reach.c FROM reach JOIN edges ON reach.d = edges.a WHERE reach.c < edges.b)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, least(docs.doc_id, min(c)) AS component_id FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON docs.doc_id = d GROUP BY docs.doc_id, n""",
}
