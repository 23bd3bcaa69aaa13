"""Queries of the extraction job (X), usage and cost (U), the web corpus (W) and streaming twins (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import batch as b
from quire.operators import usage as u
from quire.operators import web as w
from quire.streaming import jobs as s
from quire.views import Inputs

_ISSUES = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'warning' END AS level FROM ref_fields WHERE doc_id % 7 = 0"
_PRICES = [("model-a", None, "2023-06-01", 0, "1.0", "0.1", "4.0"), ("model-a", "2023-06-01", None, 0, "2.0", "0.2", "8.0"),
    ("model-a", "2023-06-01", None, 50000, "4.0", "0.4", "12.0"), ("model-b", None, None, 0, "0.5", "0.05", "1.5"),
    ("model-b", None, None, 80000, "1.0", "0.1", "3.0")]
_PRICE_SQL = "(VALUES " + ", ".join(f"('{m}', {f'DATE {a!r}' if a else 'NULL::DATE'}, {f'DATE {z!r}' if z else 'NULL::DATE'}, {n}, CAST({i} AS DECIMAL(10,4)), CAST({c} AS DECIMAL(10,4)), CAST({o} AS DECIMAL(10,4)))"
        for m, a, z, n, i, c, o in _PRICES) + ") AS p(pm, a, z, n, ip, cp, op)"
_CORPUS = "SELECT concat('/corpus/', CAST(doc_id AS VARCHAR(20))) AS path, text AS content FROM documents"
_KNOWN = """SELECT concat('/corpus/', CAST(doc_id AS VARCHAR(20))) AS source, {}CASE WHEN doc_id % 4 = 0 THEN concat(text, '!') ELSE text END{} AS fingerprint,
    CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM documents WHERE doc_id % 3 <> 0"""
_FAILURES = """SELECT event_id AS id, 1 AS cause_no, CASE event_id % 9 WHEN 0 THEN 402 WHEN 1 THEN 408 WHEN 2 THEN 409 WHEN 3 THEN 403 END AS status_code, CASE WHEN event_id % 8 = 0 THEN 'IMAGE_PARSE_ERROR' END AS structured_code, 'Network request failed: socket closed' AS message FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT event_id AS id, 0 AS cause_no, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 401 END AS status_code,
    CASE event_id % 7 WHEN 0 THEN 'resource_exhausted' WHEN 1 THEN 'EXCEEDED_CURRENT_QUOTA_ERROR' WHEN 2 THEN 'REFUSAL' WHEN 3 THEN 'odd' END AS structured_code,
    CASE WHEN event_id % 11 = 0 THEN 'fetch failed' ELSE event_type END AS message FROM events"""
_SECRETS = "SELECT doc_id, concat(text, CASE doc_id % 5 WHEN 0 THEN ' Bearer abc.def-123 ' WHEN 1 THEN ' sk-abcdefgh1234 x rk-short' WHEN 2 THEN ' api_key: zzz, Token=yy' WHEN 3 THEN ' AIzaSyA-1234567890 ' ELSE ' swordfish-9000 ' END, text) AS text FROM documents"
# what a model may have answered about a whole document: JSON alone, fenced (a broken block last), after thinking, inside prose, none
_CLEAN = "regexp_replace(text, '[^ !#-Z^-~\u00a1-\ufffd]', ' '{g})"
_RESPONSES = f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('{{"a": "', clean, '"}}') WHEN 1 THEN concat('Here: {{no', chr(10), '```json', chr(10), '{{"b": "', clean, '"}}', chr(10), '```', chr(10), '```', chr(10), '{{broken', chr(10), '```')
    WHEN 2 THEN concat('<think>', clean, '</think> {{"c": ', CAST(doc_id AS VARCHAR(20)), '}}') WHEN 3 THEN concat('Answer {{"d": ["', clean,
        '", {{"e": 1}}]}} end') WHEN 4 THEN concat(' [', CAST(doc_id AS VARCHAR(20)), '] ') ELSE text END AS text FROM (SELECT doc_id, text, {_CLEAN} AS clean
        FROM documents) q"""
_USAGE_JSON = """SELECT event_id AS request_id, CASE event_id % 3
    WHEN 0 THEN concat('{"usageMetadata": {"promptTokenCount": ', CAST(event_id % 1000 AS VARCHAR(20)),
        ', "candidatesTokenCount": 7, "thoughtsTokenCount": 3, "cachedContentTokenCount": 2}}')
    WHEN 1 THEN concat('{"usage": {"prompt_tokens": ', CAST(event_id % 1000 AS VARCHAR(20)),
        ', "completion_tokens": 5, "completion_tokens_details": {"reasoning_tokens": 4}, "cost": 0.25}}')
    ELSE concat('{"usage": {"input_tokens": ', CAST(event_id % 1000 AS VARCHAR(20)), ', "output_tokens": 6, "total_tokens": 99}}') END AS response FROM events"""
#: counters of the responses above, in the spellings that stand there
_USAGE_KEYS = {"input_tokens": ("promptTokenCount", "prompt_tokens", "input_tokens"),
    "output_tokens": ("candidatesTokenCount", "completion_tokens", "output_tokens"),
    "thought_tokens": ("thoughtsTokenCount", "completion_tokens_details.reasoning_tokens"), "cached_tokens": ("cachedContentTokenCount",),
    "total": ("total_tokens",)}
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
# URLs taken apart in SQL: scheme, authority, host, numeric address, port, path
_URLS = """u0 AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, regexp_replace(regexp_replace(url, '^[A-Za-z]+:/*', ''), '#.*$', '') AS rest FROM {source}),
  u1 AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS authority, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS raw_path, regexp_extract(rest, '(\\?.+)$',
      1) AS query FROM u0),
  u2 AS (SELECT *, regexp_extract(authority, ':([0-9]+)$', 1) AS port_text, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$',
      '')) AS host0 FROM u1),
  u3 AS (SELECT *, string_split(host0, '.') AS p, regexp_full_match(host0[length(host0) - strpos(reverse(host0), '.') + 2 - CASE WHEN contains(host0,
      '.') THEN 0 ELSE length(host0) + 1 END:], '[0-9]+|0x[0-9a-f]*') AS last_numeric FROM u2),
  u4 AS (SELECT *, regexp_full_match(p[len(p)], '[0-9]+|0x[0-9a-f]*') AS is_number, list_transform(p, lambda x: CASE WHEN regexp_full_match(x,
      '0x[0-9a-f]+') THEN TRY_CAST(x AS BIGINT) WHEN regexp_full_match(x, '0[0-7]+') THEN CAST(list_sum(list_transform(range(1, length(x) + 1),
      lambda i: CAST(x[i] AS BIGINT) * CAST(pow(8, length(x) - i) AS BIGINT))) AS BIGINT)
      WHEN regexp_full_match(x, '0|[1-9][0-9]*') THEN TRY_CAST(x AS BIGINT) END) AS n FROM u3),
  u5 AS (SELECT *, CASE WHEN is_number AND len(n) <= 4 AND len(list_filter(n, lambda x: x IS NULL)) = 0 AND len(list_filter(n[1:len(n) - 1],
      lambda x: x > 255)) = 0 AND n[len(n)] < pow(256, 5 - len(n))
      THEN n[len(n)] + coalesce(CAST(list_sum(list_transform(range(1, len(n)), lambda i: n[i] * CAST(pow(256, 4 - i) AS BIGINT))) AS BIGINT), 0) END AS address FROM u4),
  urls AS (SELECT *, CASE WHEN address IS NOT NULL THEN concat_ws('.', address // 16777216, address // 65536 % 256, address // 256 % 256, address % 256)
      ELSE host0 END AS host, scheme IN ('http', 'https', 'ftp') AND NOT (is_number AND address IS NULL) AND host0 <> '' AS valid,
      CASE WHEN port_text = '' OR (scheme, port_text) IN (('http', '80'), ('https', '443'), ('ftp', '21')) THEN '' ELSE concat(':', port_text) END AS port,
          regexp_replace(regexp_replace(raw_path, '/\\./', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g') AS path FROM u5),
  keyed AS (SELECT *, CASE WHEN valid THEN concat(scheme, '://', host, port, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path,
      '/+$', '') END, query) ELSE regexp_replace(lower(url), '/+$', '') END AS key FROM urls)"""
_ENTITIES_SQL = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<svg\b[^>]*>.*?</svg\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/(?:p|div|li|h[1-6]|tr|title|ul|ol|table|section|article|nav|header|footer))\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", "chr(32)"), ("&lt;", "chr(60)"), ("&gt;", "chr(62)"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "chr(38)")):
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '{_entity}', {_char})"
_PAGE_TEXT = f"regexp_replace(regexp_replace(regexp_replace({_ENTITIES_SQL}, '[ \\t\u00a0]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_REDACT = [("bearer", r"(?i)\b(bearer)\s+[A-Za-z0-9._+=/-]+", "Bearer [REDACTED]"), ("key", r"\b[sr]k-[A-Za-z0-9_-]{8,}", "[REDACTED_KEY]"), ("google", r"\bAIza[A-Za-z0-9_-]{10,}", "[REDACTED_KEY]"),
           ("assignment", r"(?i)\b(apikey|api_key|api-key|token|authorization)\s*[:=]\s*[\x27\x22]?[^\s\x27\x22,;]+", r"\1=[REDACTED]")]
_REDACT_SQL = f"WITH s AS ({_SECRETS}), r0 AS (SELECT doc_id, replace(text, 'swordfish-9000', '[REDACTED_KEY]') AS t FROM s)"
for _i, (_kind, _pattern, _to) in enumerate(_REDACT):
    _REDACT_SQL += f", r{_i + 1} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{_pattern}')) AS n_{_kind}, regexp_replace(t, '{_pattern}', '{_to}', 'g') AS t FROM r{_i})"
_REDACT_SQL += " SELECT * RENAME (t AS redacted) FROM r4"


def _prices(v: Inputs):
    import datetime
    from decimal import Decimal

    day = lambda t: None if t is None else datetime.date.fromisoformat(t)
    return v.spark.createDataFrame([(m, day(a), day(z), n, *map(Decimal, x)) for m, a, z, n, *x in _PRICES], u.PRICE_COLUMNS)


_PRICED = f"""priced AS (SELECT u.* EXCLUDE (custom_input, custom_output), CASE WHEN c THEN custom_input WHEN provider <> 'openai-compatible' THEN ip END AS ip, CASE WHEN NOT c AND provider <> 'openai-compatible' THEN cp END AS cp, CASE WHEN c THEN custom_output WHEN provider <> 'openai-compatible' THEN op END AS op
    FROM (SELECT *, custom_input IS NOT NULL AND custom_output IS NOT NULL AS c FROM usage_log) u LEFT JOIN {_PRICE_SQL} ON model = pm AND (a IS NULL
        OR CAST(ts AS DATE) >= a) AND (z IS NULL OR CAST(ts AS DATE) < z) AND input_tokens >= n QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n
        DESC) = 1),
  costed AS (SELECT *, CASE WHEN exact_cost > 0 THEN CAST(exact_cost AS DECIMAL(20,8)) ELSE coalesce(CAST(round(CAST((input_tokens - least(cached_tokens,
      input_tokens)) * ip + least(cached_tokens, input_tokens) * coalesce(cp, ip) + (output_tokens + CASE WHEN thoughts_in_output THEN 0
      ELSE thought_tokens END) * op AS DECIMAL(28,4)) * CAST(0.000001 AS DECIMAL(7,6)), 8) AS DECIMAL(20,8)), CAST(exact_cost AS DECIMAL(20,8))) END AS cost
      FROM priced)"""
_RETURNED = """SELECT url, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE html END AS content FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT concat(url, '/'), html FROM pages WHERE page_id % 12 = 1
    UNION ALL SELECT concat('http://other:80/./', CAST(page_id AS VARCHAR(20))), html FROM pages WHERE page_id % 10 = 3"""
# a host of each sixth page, ranges of both families, and rows that block nothing
_BLOCKLIST = """SELECT 'suffix' AS kind, concat('*.', regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS value FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT 'suffix', 'b.example.net'
    UNION ALL SELECT 'cidr', concat('8.8.', CAST(n_nationkey AS VARCHAR(20)), '.0/24') FROM nation UNION ALL
        SELECT 'cidr', concat('2606:4700:', CAST(r_regionkey AS VARCHAR(20)), '::/48') FROM region
    UNION ALL SELECT 'cidr', '9.9.9.9' UNION ALL SELECT 'cidr', '300.1.1.1/8' UNION ALL SELECT 'cidr', '1.2.3.4/99' UNION ALL SELECT 'other', 'example.org'
        UNION ALL SELECT NULL, NULL"""
_MORE_URLS = """SELECT pos, url FROM url_list UNION ALL SELECT page_id * 5 + 1000000000, concat('https://[2606:4700:', CAST(page_id % 10 AS VARCHAR(20)), '::', CAST(page_id % 7 AS VARCHAR(20)), ']/p') FROM pages
    UNION ALL SELECT page_id * 5 + 1000000001, concat('http://', CASE page_id % 3 WHEN 0 THEN 'a.b.example.net' WHEN 1 THEN 'ab.example.net'
        ELSE '9.9.9.9' END, '/q') FROM pages"""
_SITES = "SELECT page_id AS pos, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN ' ' ELSE concat('P', CAST(page_id AS VARCHAR(20))) END AS title, url, CASE WHEN page_id % 11 > 0 THEN html END AS text, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site FROM pages"


def _costed(v: Inputs):
    return u.estimate_cost(u.attach_prices(v("usage_log"), _prices(v)))


def _outcomes(v: Inputs):
    made = b.extract_batch(v("documents").select(F.col("doc_id").alias("id"), "text"), b.line_extractor)
    return made.select("id", "status", F.size(F.json_object_keys("text")).cast("long").alias("keys"), "attempts", "error", "input_tokens")


PLANS = {
    "x01_extract_batch": (_outcomes, """
        WITH l AS (SELECT doc_id AS id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ':')),
            lambda x: struct_pack(k := regexp_replace(x[1:strpos(x, ':') - 1], '^\\s+|\\s+$', '', 'g'), v := regexp_replace(x[strpos(x, ':') + 1:],
            '^\\s+|\\s+$', '', 'g'))) AS pairs FROM documents)
        SELECT id, CASE WHEN regexp_full_match(text, '\\s*') THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN NOT regexp_full_match(text,
            '\\s*') THEN CAST(len(list_distinct(list_transform(pairs, lambda p: p.k))) AS BIGINT) END AS keys, 1 AS attempts,
          CASE WHEN regexp_full_match(text, '\\s*') THEN 'ValueError: empty document' END AS error, CASE WHEN regexp_full_match(text, '\\s*') THEN 0
              ELSE length(text) END AS input_tokens FROM l"""),
    "x02_parse_responses": (lambda v: b.parse_responses(v.sql(_RESPONSES.replace("{g}", ""))).select("doc_id", "route", F.sha2("json", 256).alias("json")), f"""
        WITH r AS (SELECT doc_id, trim(regexp_replace(text, '^\\s*<think>(?s:.*?)</think>', ''), chr(32)) AS t FROM ({_RESPONSES.replace("{g}", ", 'g'")})),
          f AS (SELECT *, list_filter(regexp_extract_all(t, '```(?:json)?[ \\t]*\\n((?s:.*?))```', 1), lambda x: json_valid(x)) AS blocks, regexp_extract(t,
              '\\{{"(?s:.*)\\}}') AS inner_json FROM r)
        SELECT doc_id, CASE WHEN json_valid(t) THEN 'whole' WHEN len(blocks) > 0 THEN 'fenced' WHEN json_valid(inner_json) THEN 'embedded' ELSE 'none' END AS route,
          sha256(CASE WHEN json_valid(t) THEN t WHEN len(blocks) > 0 THEN trim(blocks[len(blocks)], concat(chr(32), chr(10)))
              WHEN json_valid(inner_json) THEN inner_json END) AS json FROM f"""),
    "x03_classify_errors": (lambda v: b.classify_errors(v.sql(_FAILURES)), f"""
        WITH f AS ({_FAILURES}), v AS (SELECT id, cause_no, CASE WHEN upper(structured_code) IN ('MODEL_REFUSAL', 'REFUSAL',
            'CONTENT_POLICY_VIOLATION') THEN 'PROVIDER_FAILURE|provider|false' WHEN upper(structured_code) IN ('RESOURCE_EXHAUSTED', 'RATE_LIMITED',
            'TOO_MANY_REQUESTS') THEN 'RATE_LIMITED|provider|true'
            WHEN upper(structured_code) IN ('EXCEEDED_CURRENT_QUOTA_ERROR', 'INSUFFICIENT_QUOTA') THEN 'RATE_LIMITED|provider|false'
                WHEN upper(structured_code) = 'IMAGE_PARSE_ERROR' THEN 'INPUT_INVALID|input|false'
                WHEN status_code = 401 THEN 'AUTH_INVALID|authentication|false' WHEN status_code = 402 THEN 'RATE_LIMITED|provider|false'
            WHEN status_code = 403 THEN 'PERMISSION_DENIED|authorization|false' WHEN status_code IN (408, 504) THEN 'TIMEOUT|limit|true'
                WHEN status_code = 429 THEN 'RATE_LIMITED|provider|true' WHEN status_code BETWEEN 500 AND 599
                OR status_code = 409 THEN 'PROVIDER_FAILURE|provider|true'
            WHEN regexp_matches(lower(message), '\\b(fetch failed|network failed|network request failed|socket closed|socket hang up)\\b') THEN
                'PROVIDER_FAILURE|provider|true' END AS x FROM f), c AS (SELECT id, coalesce(arg_min(x, cause_no) FILTER (x IS NOT NULL),
                'INTERNAL|internal|false') AS x FROM v GROUP BY id)
        SELECT id, split_part(x, '|', 1) AS code, split_part(x, '|', 2) AS category, split_part(x, '|', 3) = 'true' AS retryable FROM c"""),
    "x04_retry_outcomes": (lambda v: b.retry_outcomes(v("attempts")), """
        WITH x AS (SELECT *, status_code IN (429, 503) AND attempt <= CASE WHEN mode = 'agentic' THEN 0 ELSE 3 END AND NOT quota_exhausted AS ok FROM attempts)
        SELECT doc_id, attempt, status_code, ok AS retry_allowed, CASE WHEN ok THEN CASE WHEN retry_after_s IS NOT NULL THEN least(retry_after_s * 1000, 60000)
            ELSE CAST(750 * pow(2, attempt - 1) AS BIGINT) END END AS delay_ms FROM x"""),
    "x04_final_outcomes": (lambda v: b.final_outcomes(v("attempts")), "SELECT doc_id, max(attempt) AS attempts, arg_max(status_code, attempt) AS status_code FROM attempts GROUP BY doc_id"),
    "x05_redact_secrets": (lambda v: b.redact_secrets(v.sql(_SECRETS), known_secrets=["swordfish-9000", "short"]).select("doc_id", "redacted", "n_bearer", "n_key", "n_google", "n_assignment"), _REDACT_SQL),
    "x06_batch_summary": (lambda v: b.batch_summary(v("results")).select("run_id", "total", "succeeded", "partial", "failed", "skipped", F.col("cost").cast("double").alias("cost"), "exit_code"), """
        SELECT run_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'partial') AS partial,
            count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
          CAST(sum(cost) AS DOUBLE) AS cost, CASE WHEN count(*) FILTER (status IN ('partial', 'failed')) > 0 THEN 1 ELSE 0 END AS exit_code FROM results
              GROUP BY run_id"""),
    "x07_run_status": (lambda v: b.run_status(v("results")), """
        SELECT run_id, CASE WHEN bool_or(coalesce(skip_reason = 'cost-limit', false)) THEN 'cost_limited' WHEN bool_or(coalesce(skip_reason = 'cancelled',
            false)) THEN 'cancelled' WHEN bool_and(coalesce(skip_reason = 'validated', false)) THEN 'validated' WHEN bool_or(status = 'failed')
            AND NOT bool_or(status IN ('succeeded', 'partial') OR coalesce(skip_reason IN ('resumed', 'validated'), false)) THEN 'failed'
            WHEN bool_or(status IN ('failed', 'partial')) THEN 'partial' ELSE 'succeeded' END AS status FROM results GROUP BY run_id"""),
    "x08_fail_fast_cutoff": (lambda v: b.fail_fast_cutoff(v("results")), """
        SELECT run_id, pos, doc_id, CASE WHEN late THEN 'skipped' ELSE status END AS status, CASE WHEN late THEN 'NOT_RUN' END AS code
        FROM (SELECT *, coalesce(bool_or(status = 'failed') OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            false) AS late FROM results)"""),
    "x09_outcome_status": (lambda v: b.outcome_status(v("results"), v.sql(_ISSUES)), f"""
        WITH e AS (SELECT doc_id, count(*) AS n FROM ({_ISSUES}) WHERE level = 'error' GROUP BY doc_id), m AS (SELECT *
            FROM (VALUES ('partial', 'readiness_not_met', 'review_partial_output'), ('max_iterations', 'max_iterations', 'increase_max_iterations'),
            ('tool_limit_reached', 'tool_limit_reached', 'retry_document'),
            ('budget_exhausted', 'time_budget_reached', 'increase_timeout'), ('cost_limit_reached', 'cost_limit_reached', 'increase_max_cost'), ('confused',
            'confused', 'review_partial_output')) AS v(stop, why, next)),
          j AS (SELECT r.doc_id, r.status, coalesce(why, CASE WHEN n IS NOT NULL THEN 'validation_failed' END) AS why, coalesce(next, CASE
              WHEN n IS NOT NULL THEN 'review_partial_output' END) AS next, coalesce(n, 0) AS errors
              FROM results r LEFT JOIN e ON r.doc_id = e.doc_id LEFT JOIN m ON stop = stop_reason)
        SELECT doc_id, CASE WHEN status = 'succeeded' AND why IS NOT NULL THEN 'partial' ELSE status END AS status, CASE
            WHEN status = 'succeeded' THEN why END AS reason, CASE WHEN status = 'succeeded' THEN next END AS next_action, errors FROM j"""),
    "u01_usage_from_responses": (lambda v: u.usage_from_responses(v.sql(_USAGE_JSON)).drop("response"), f"""
        WITH r AS (SELECT request_id, coalesce(json_extract(response, '$.usageMetadata'), json_extract(response, '$.usage')) AS u FROM ({_USAGE_JSON})),
          n AS (SELECT request_id, {", ".join(f"coalesce({', '.join(f"TRY_CAST(json_extract_string(u, '$.{k}') AS BIGINT)" for k in keys)}, 0) AS {name}" for name, keys in _USAGE_KEYS.items())},
                  TRY_CAST(json_extract_string(u, '$.cost') AS DOUBLE) AS exact_cost, json_exists(u, '$.completion_tokens') OR json_exists(u,
                      '$.output_tokens') AS one FROM r)
        SELECT request_id, input_tokens, output_tokens, thought_tokens, cached_tokens, exact_cost, CASE WHEN total > 0 THEN total
            ELSE input_tokens + output_tokens + CASE WHEN one THEN 0 ELSE thought_tokens END END AS total_tokens FROM n"""),
    "u02_combine_parts": (lambda v: u.combine_parts(v("usage_log").withColumn("request_id", F.floor(F.col("request_id") / 3)).withColumn("exact_cost", F.when(F.col("request_id") % 4 > 0, F.col("exact_cost").cast("double")).when(F.lit(True), 0.5))), """
        SELECT request_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CASE
            WHEN bool_and(c IS NOT NULL) THEN sum(c) END AS exact_cost, count(*) AS parts
        FROM (SELECT CAST(floor(request_id / 3.0) AS BIGINT) AS request_id, input_tokens, output_tokens, CASE
            WHEN CAST(floor(request_id / 3.0) AS BIGINT) % 4 > 0 THEN CAST(exact_cost AS DOUBLE) ELSE 0.5 END AS c FROM usage_log) GROUP BY request_id"""),
    "u03_attach_prices": (lambda v: u.attach_prices(v("usage_log"), _prices(v)).select("request_id", *[F.col(c).cast("double").alias(c) for c in ("input_price", "cached_price", "output_price")]), f"""
        WITH {_PRICED} SELECT request_id, CAST(ip AS DOUBLE) AS input_price, CAST(cp AS DOUBLE) AS cached_price, CAST(op AS DOUBLE) AS output_price FROM priced"""),
    "u04_estimate_cost": (lambda v: _costed(v).select("request_id", F.col("cost").cast("double").alias("cost")), f"WITH {_PRICED} SELECT request_id, CAST(cost AS DOUBLE) AS cost FROM costed"),
    "u05_usage_rollup": (lambda v: u.usage_rollup(_costed(v), "job_id", "model").withColumn("cost", F.col("cost").cast("double")), f"""
        WITH {_PRICED} SELECT job_id, model, count(*) AS requests, count(*) FILTER (NOT reported) AS unreported,
            CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
            CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost FROM costed GROUP BY ROLLUP (job_id, model)"""),
    "u06_cost_admission": (lambda v: u.cost_admission(v("results"), 1.0, 0.1, 64).select("run_id", "pos", "doc_id", F.col("spent_before").cast("double").alias("spent_before"), "admitted", "reason"), """
        WITH x AS (SELECT *, CAST(coalesce(sum(CASE WHEN skip_reason = 'resumed' THEN 0 ELSE cost END) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN
            UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(20,8)) AS sb FROM results)
        SELECT run_id, pos, doc_id, CAST(sb AS DOUBLE) AS spent_before, coalesce(skip_reason = 'resumed', false)
            OR sb + CAST(0.1 AS DECIMAL(20,8)) < 1.0::DECIMAL(20,8) AS admitted,
          CASE WHEN NOT (coalesce(skip_reason = 'resumed', false) OR sb + CAST(0.1 AS DECIMAL(20,8)) < 1.0::DECIMAL(20,8)) THEN 'cost-limit' END AS reason FROM x"""),
    "u07_usage_gaps": (lambda v: u.usage_gaps(v("results")), """
        SELECT run_id, pos, doc_id, count(*) FILTER (NOT reported AND skip_reason IS NULL) OVER (PARTITION BY run_id) AS gaps,
          coalesce(bool_or(NOT reported AND skip_reason IS NULL) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              false) AS closed FROM results"""),
    "u08_cumulative_usage": (lambda v: u.cumulative_usage(_costed(v).where("request_id % 2 = 0"), _costed(v).where("request_id % 2 = 1")).withColumn("cost", F.col("cost").cast("double")), f"""
        WITH {_PRICED} SELECT job_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
            count(*) AS requests, CAST(sum(cost) AS DOUBLE) AS cost FROM costed GROUP BY job_id"""),
    "u09_throttle_audit": (lambda v: u.throttle_audit(v("usage_log"), 60), """
        WITH x AS (SELECT job_id, request_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY job_id ORDER BY ts, request_id) - 1 AS i FROM usage_log)
        SELECT job_id, request_id, ms - lag(ms) OVER w AS since_ms, coalesce(ms - lag(ms) OVER w < 1000, false) AS too_soon,
            max(ms - i * 1000) OVER (PARTITION BY job_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 1000 AS earliest_ms
            FROM x WINDOW w AS (PARTITION BY job_id ORDER BY i)"""),
    "w01_filter_urls": (lambda v: w.filter_urls(v("url_list")), f"""
        WITH {_URLS.format(source="url_list")} SELECT pos, url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(authority,
            '@') THEN 'credentials' WHEN host = 'localhost' THEN 'loopback' WHEN NOT valid THEN 'host'
          WHEN address // 16777216 IN (0, 10, 127) OR address // 65536 IN (43518, 49320) OR address >= 3758096384 THEN 'private-address'
              WHEN host LIKE '%.ngrok.io' THEN 'tunnel' END AS reason FROM urls"""),
    "w01_filter_urls_blocklists": (lambda v: w.filter_urls(v.sql(_MORE_URLS), v.sql(_BLOCKLIST)), f"""
        WITH {_URLS.format(source=f"({_MORE_URLS})")}, l AS ({_BLOCKLIST}), named AS (SELECT DISTINCT ltrim(value, '*.') AS v FROM l
            WHERE kind = 'suffix'), ranges AS (SELECT DISTINCT replace(replace(value, '0/24', ''), ':/48', '') AS v FROM l WHERE kind = 'cidr'),
          below AS (SELECT DISTINCT host FROM (SELECT host, array_to_string(list_slice(p, i, len(p)), '.') AS tail
              FROM (SELECT DISTINCT host, string_split(host, '.') AS p, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM urls
              WHERE address IS NULL)) JOIN named ON tail = v),
          inside AS (SELECT DISTINCT host FROM (SELECT DISTINCT host FROM urls WHERE address IS NOT NULL OR host LIKE '[%') JOIN ranges ON host = v
              OR (v LIKE '8.8.%' AND starts_with(host, v)) OR starts_with(host, '[' || v || ':'))
        SELECT pos, url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(authority, '@') THEN 'credentials'
            WHEN host = 'localhost' THEN 'loopback' WHEN NOT valid AND host NOT LIKE '[%' THEN 'host'
          WHEN address // 16777216 IN (0, 10, 127) OR address // 65536 IN (43518, 49320) OR address >= 3758096384 THEN 'private-address'
              WHEN host LIKE '%.ngrok.io' THEN 'tunnel'
          WHEN host IN (SELECT host FROM below) OR host IN (SELECT host FROM inside) THEN 'blocked' END AS reason FROM urls"""),
    "w02_dedupe_urls": (lambda v: w.dedupe_urls(v("url_list")), f"WITH {_URLS.format(source='url_list')} SELECT key, arg_min(url, pos) AS url, min(pos) AS pos, count(*) - 1 AS duplicates FROM keyed GROUP BY 1"),
    "w03_reconcile_results": (lambda v: w.reconcile_results(v("url_list"), v.sql(_RETURNED)), f"""
        WITH {_URLS.format(source=f"(SELECT 0 AS side, url, NULL AS content FROM url_list UNION ALL SELECT 1, url, content FROM ({_RETURNED}) t)")},
          q AS (SELECT DISTINCT key FROM keyed WHERE side = 0), g AS (SELECT key, count(*) AS n, bool_or(trim(content) <> '') AS filled FROM keyed
              WHERE side = 1 GROUP BY 1)
        SELECT coalesce(q.key, g.key) AS key, CASE WHEN q.key IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated'
            WHEN NOT filled THEN 'empty' ELSE 'matched' END AS verdict FROM q FULL OUTER JOIN g ON q.key = g.key"""),
    "w04_page_text": (lambda v: w.page_text(v("pages")).select("page_id", "text"), f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages"),
    "w04_text_profile": (lambda v: w.text_profile(w.page_text(v("pages"))), f"SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM (SELECT url, {_PAGE_TEXT} AS text FROM pages) GROUP BY 1"),
    "w05_combine_pages": (lambda v: w.combine_pages(v.sql(_SITES), "site").withColumn("combined", F.sha2("combined", 256)), f"""
        WITH y AS (SELECT * REPLACE (coalesce(text, '') AS text, coalesce(nullif(trim(title), ''), url) AS title)
            FROM ({_SITES}) QUALIFY row_number() OVER (PARTITION BY site, coalesce(text, '') ORDER BY pos) = 1)
        SELECT site, CAST(floor(pos / 64) AS BIGINT) AS part, count(*) AS pages, sha256(string_agg(concat('# ', title, chr(10), 'Source: ', url, chr(10),
            chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY pos)) AS combined FROM y GROUP BY ALL"""),
    "s01_ingest_batch": (lambda v: s.new_documents(v.sql(_CORPUS), v.sql(_KNOWN.format("sha2(", ", 256)"))).select("source", "fingerprint"), f"""
        WITH d AS (SELECT path, sha256(content) AS h FROM ({_CORPUS})), k AS ({_KNOWN.format("sha256(", ")")}) SELECT DISTINCT path AS source, h AS fingerprint
            FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = path AND k.fingerprint = h AND status = 'succeeded')"""),
    "s02_document_lifecycle": (lambda v: s.document_lifecycle(v("run_events")), "SELECT run_id, document_id, arg_max(type, sequence * 100 + length(type)) AS state, max(sequence) AS sequence FROM run_events WHERE type LIKE 'document.%' GROUP BY run_id, document_id"),
    "s03_sequence_audit": (lambda v: s.sequence_audit(v("run_events")), """
        WITH x AS (SELECT run_id, sequence - lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence) AS step
            FROM run_events), g AS (SELECT run_id, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (step = 0) AS repeats, count(*) AS events FROM x
            GROUP BY run_id),
          d AS (SELECT run_id, document_id, bool_or(type = 'document.started') AS a, bool_or(type IN ('document.completed', 'document.failed',
              'document.partial', 'document.skipped')) AS z FROM run_events WHERE type LIKE 'document.%' GROUP BY run_id, document_id),
          l AS (SELECT run_id, count(*) FILTER (sequence > first_end) AS late FROM (SELECT *, min(sequence) FILTER (type IN ('run.completed',
              'run.failed')) OVER (PARTITION BY run_id) AS first_end FROM run_events) GROUP BY run_id)
        SELECT g.run_id, gaps, repeats, events, unstarted, unended, late FROM g JOIN (SELECT run_id, count(*) FILTER (NOT a) AS unstarted,
            count(*) FILTER (NOT z) AS unended FROM d GROUP BY run_id) o ON g.run_id = o.run_id JOIN l ON l.run_id = g.run_id"""),
    "s04_running_usage": (lambda v: s.running_usage(v("usage_log"), 1_000_000), "SELECT job_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS requests, sum(input_tokens) + sum(output_tokens) >= 1000000 AS cap_reached FROM usage_log GROUP BY job_id"),
}
