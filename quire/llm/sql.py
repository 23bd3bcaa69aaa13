"""The queries that SQL can express, for DuckDB."""

OP1 = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    marked AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS begins
        FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    sized AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS t_chars, length(replace(replace(replace(role, '&',
        '&amp;'), '<', '&lt;'), '"', '&quot;')) AS r_chars FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST,
    role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(t_chars + CASE WHEN begins = 1 THEN length('<turn role="">') + r_chars + length('</turn>') + 1 ELSE length('<part/>') END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

OP4 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    grams AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 2), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    inside AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    f AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
            len(regexp_extract_all(text, '[A-Z]')) AS capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS letters
          FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN inside ON inside.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * capitals > 40 * letters OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM f"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', rpad(substr(h,
        CAST(5 * i // 4 + 1 AS BIGINT), 2), 2, '0')) AS BIGINT) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM p"""

OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
    late AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
    lost AS (SELECT DISTINCT doc_id, i + k AS i FROM late CROSS JOIN (SELECT unnest(range(0, 13)) AS k)),
    each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) FILTER (l.i IS NULL) AS text, count(l.i) AS n_removed
        FROM each e LEFT JOIN lost l ON l.doc_id = e.doc_id AND l.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

OP10 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 5"""

OP11 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score
        DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

ORACLES = {"op1_chat_format": OP1, "op4_quality_rules": OP4, "op6_warc": OP6, "op8_substring_dedup": OP8, "op10_top_k": OP10, "op11_hard_negatives": OP11}
