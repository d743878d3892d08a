"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH digests AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
kept AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM digests)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM kept
"""

# CRC-32 byte by byte, with the table made from its polynomial.
OP5 = """
WITH remainders AS (
    SELECT list(r ORDER BY n) AS t FROM (
        SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
        FROM range(256) AS numbers(n))),
bytes AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
    SELECT doc_id, coalesce('=' || source, '') AS stratum, size,
           xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, size - 1),
               lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
           ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS shuffled
    FROM bytes, remainders),
ranked AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY shuffled, doc_id, size, text_crc32) - 1)::DOUBLE
              / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS fraction
    FROM sized),
mixed AS (
    SELECT *, row_number() OVER (ORDER BY fraction, stratum, shuffled, doc_id, size, text_crc32) - 1 AS pos,
           count(*) OVER () AS n
    FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((pos * 8) // n)::INTEGER AS shard,
       (pos - ((pos * 8) // n * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM mixed
"""

# Five hex digits are four signs of base32.
OP6 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
    SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)),
                  lambda a, b: a || b) AS payload_digest,
           min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id
    FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digests
"""

OP11 = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same)
    WHERE r <= 5),
negatives AS (
    SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
         AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE r <= 5
"""

OP12 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
full_counts AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
         LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
    SELECT lang, source, term, n, (1 + (1000000000::BIGINT * (n + 2)) // (total + 2 * v)::BIGINT)::BIGINT AS p,
           sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang, v
    FROM full_counts),
both_shares AS (
    SELECT *, (1 + (1000000000::BIGINT * (n_lang + 2)::BIGINT) // (total_lang + 2 * v)::BIGINT)::BIGINT AS q FROM shares),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
    FROM both_shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
    FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""

# A mark of the template is 13 or 15 signs around a user's text, 17 around a system's, 9 around an assistant's.
OP13 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
    SELECT *, role || chr(10) || text || chr(10) AS told, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
           length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|ROLE\]|/?TEXT\]|/?s>|</?SYS>>)', '\1\2\\\3', 'g'))
           + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 9
                  ELSE 23 + length(regexp_replace(role, '([<\[])(\\*)(/?INST\]|ROLE\]|/?TEXT\]|/?s>|</?SYS>>)', '\1\2\\\3', 'g')) END AS chars
    FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(told, '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

ORACLES = {"op3_exact_dedup": OP3, "op5_sharding": OP5, "op6_warc": OP6, "op11_hard_negatives": OP11, "op12_divergence": OP12,
           "op13_chat_format": OP13}
