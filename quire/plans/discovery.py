"""Queries of sources, discovery and sinks (D) and of incremental planning (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.tables import fresh_path
from quire.operators import resume as r
from quire.sources import discovery as d
from quire.views import Inputs

PATTERNS = ["drafts/**", "**/*.txt", "no-such/*", "root/src1/*"]
_MANIFEST = """SELECT source, fingerprint, fingerprint_version, status, queued, output_file, updated FROM manifest_view"""
_INNER = "regexp_replace(path, '^root/', '')"


def _manifest(v: Inputs):
    m = v("manifest_view")
    files = F.when(F.col("status") == "pending", F.array().cast("array<string>")).otherwise(F.array("output_file"))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("failed: "), "source"))
    return m.withColumn("output_files", files).withColumn("owned_files", F.array("output_file")).withColumn("error", error)


def _updates(v: Inputs):
    n = v.sql("SELECT source, 'new' AS fingerprint, 'succeeded' AS status, concat('out/new-', CAST(doc_id AS VARCHAR(20)), '.md') AS output_file, doc_id + "
            "10 AS updated FROM inputs_view WHERE doc_id % 4 = 1")
    return n.select("source", "fingerprint", "status", F.array("output_file").alias("output_files"), F.array("output_file").alias("owned_files"), "updated")


_PROVIDERS = [("any", None, "true"), ("images-only", None, "false"), ("png-only", ["image/png"], "unknown"), ("jpeg", ["image/jpeg", "image/webp"], "model-dependent")]


def _mime(v: Inputs):
    return v("files").select("path", F.when(F.lower("path").endswith(".pdf"), "application/pdf").when(F.lower("path").endswith(".png"), "image/png").otherwise("text/plain").alias("mime"))


def _planned(v: Inputs):
    f = v("files").select(F.regexp_replace("path", "^root/", "").alias("path"))
    return d.plan_output_paths(f, "out", ["md", "json"])


_RESULTS = """SELECT concat(source, '/', CAST(doc_id AS VARCHAR(20))) AS target, text AS markdown, CASE WHEN doc_id % 3 = 0 THEN concat('{"id": ', CAST(doc_id AS VARCHAR(20)), ', "lang": "', lang, '", "tags": ["a"]}') END AS json,
    CASE WHEN n_chars % 2 = 0 THEN concat('id,chars', chr(10), CAST(doc_id AS VARCHAR(20)), ',', CAST(n_chars AS VARCHAR(20)), chr(10)) END AS csv FROM documents"""


def _written_artifacts(v: Inputs):
    """Artifacts are written below the shared folder and read back: the name and body of each file."""
    folder = fresh_path(v.spark, "artifacts")
    made = d.write_artifacts(v.sql(_RESULTS), folder)
    return d.read_artifacts(made).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"),
        F.length(F.col("content").cast("string")).cast("long").alias("chars"), F.sha2("content", 256).alias("sha"))


_PLANNED = f"""p AS (SELECT {_INNER} AS path FROM files), q AS (SELECT path, string_split(path, '/') AS s FROM p),
  t AS (SELECT path, list_filter(s[1:len(s)-1], lambda x: x NOT IN ('', '.', '..')) AS f, regexp_replace(s[len(s)], '\\.[^.]*$', '') AS stem FROM q),
  u AS (SELECT path, list_append(f, CASE WHEN lower(stem) IN ('agents', 'agent', 'claude', 'gemini', 'codex', 'skill', 'conventions') THEN concat(stem, '.ocr')
      ELSE stem END) AS f FROM t),
  planned AS (SELECT path, format, concat('out/', array_to_string(list_transform(f, lambda x: CASE WHEN starts_with(x, '.') THEN concat('_', x) ELSE x END),
      '/'), '.', format) AS target
              FROM u CROSS JOIN (SELECT unnest(['md', 'json']) AS format))"""

_HEADS = ["255044462D", "89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "474946383961", "0000001C6674797068656963000000006D696631", "0000001C6674797061766966000000006D696631", "00",
          "00000018667479706D696631000000006176696673747566", "00000000667479706D73663100000000", "0000000866747970686569630000", "00000018667479707174202000000000686569787374756666"]
_KINDS = ["application/pdf", "image/png", "image/jpeg", "image/webp", "image/gif", "image/heic", "image/heif", "image/png"]
_MEDIA_SQL = f"""
        WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, {_KINDS}[CAST((CASE WHEN doc_id % 11 = 0 THEN doc_id + 1
            ELSE doc_id END) % {len(_KINDS)} + 1 AS INT)] AS declared, concat({_HEADS}[CAST(doc_id % {len(_HEADS)} + 1 AS INT)], hex(encode(text))) AS h
            FROM documents),
          b AS (SELECT *, length(h) // 2 AS size, substr(h, 1, 512) AS k, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS box FROM f),
          r AS (SELECT *, CASE WHEN substr(k, 9, 8) = '66747970' AND box <> 1 AND (box = 0 OR box >= 16) THEN list_concat([substr(k, 17, 8)],
              list_transform(list_filter(range(16, 256, 4), lambda o: o + 4 <= CASE WHEN box = 0 THEN length(k) // 2 ELSE least(box, length(k) // 2) END),
              lambda o: substr(k, o * 2 + 1, 8))) END AS brands FROM b),
          s AS (SELECT *, CASE WHEN starts_with(k, hex('%PDF')) THEN 'application/pdf' WHEN starts_with(k, '89504E470D0A1A0A') THEN 'image/png'
              WHEN starts_with(k, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(k, hex('RIFF')) AND substr(k, 17, 8) = hex('WEBP') THEN 'image/webp'
              WHEN starts_with(k, hex('GIF87a')) OR starts_with(k, hex('GIF89a')) THEN 'image/gif' WHEN list_has_any(brands, [hex('avif'),
                  hex('avis')]) THEN NULL WHEN list_has_any(brands, [hex('heic'), hex('heix'), hex('hevc'), hex('hevx')]) THEN 'image/heic'
              WHEN list_has_any(brands, [hex('mif1'), hex('msf1'), hex('heim'), hex('heis'), hex('hevm'), hex('hevs')]) THEN 'image/heif' END AS sniffed FROM r)
        SELECT path, declared, sniffed, CASE WHEN size = 0 THEN 'empty' WHEN size > CASE WHEN declared = 'application/pdf' THEN 52428800
            ELSE 73400320 END THEN 'too-large' WHEN sniffed IS NULL THEN 'unknown' WHEN sniffed <> declared THEN 'mismatch' ELSE 'ok' END AS verdict FROM s"""

_STATUS_SQL = """WITH {sums} m AS (SELECT status, queued, output_file, coalesce(status IN ('succeeded', 'partial') AND output_file NOT IN (SELECT path FROM existing_files), false)
            OR status = 'failed' AND output_file NOT IN (SELECT path FROM existing_files) AS gone, source NOT IN (SELECT source FROM inputs_view
                WHERE doc_id % 13 <> 0{more}) AS lost FROM manifest_view),
          u AS (SELECT count(*) FILTER (kind = 'untracked') AS untracked_artifacts, count(*) FILTER (kind = 'stray') AS stray_files
              FROM (SELECT 'untracked' AS kind FROM existing_files WHERE regexp_matches(path, '\\.(md|csv|json)$') AND path NOT IN (SELECT output_file
              FROM manifest_view)
              AND regexp_replace(path, '\\.(md|csv|json)$', '') IN (SELECT regexp_replace(output_file, '\\.md$', '') FROM manifest_view) UNION ALL
                  SELECT 'stray' FROM existing_files WHERE path LIKE '%.tmp'))
        SELECT {counts}, count(*) FILTER (status = 'pending' AND NOT queued) AS interrupted, count(*) FILTER (status = 'pending' AND queued) AS waiting,
            count(*) FILTER (gone) AS missing_artifacts, count(*) FILTER (lost) AS missing_sources,
          any_value(u.untracked_artifacts) AS untracked_artifacts, any_value(u.stray_files) AS stray_files, any_value(last_run_incomplete) AS last_run_incomplete,
          count(*) FILTER (status <> 'succeeded' OR gone) = 0 AND any_value(u.untracked_artifacts + u.stray_files) = 0 AND any_value(last_run_ok) AS healthy {extra}, u"""

_ENTRIES = """SELECT source, CASE WHEN updated % 11 = 0 THEN ' ' ELSE fingerprint END AS fingerprint, CASE WHEN updated % 17 = 0 THEN 3 ELSE fingerprint_version END AS fingerprint_version, CASE WHEN updated % 13 = 0 THEN 'done' ELSE status END AS status, queued,
    CASE WHEN updated % 19 = 0 THEN {none} WHEN updated % 23 = 0 THEN {blank} ELSE {own} END AS output_files, CASE updated % 10 WHEN 0 THEN 'yesterday'
        WHEN 1 THEN '2026-13-01T00:00:00Z' WHEN 2 THEN NULL WHEN 3 THEN '2026-03-01' WHEN 4 THEN '2026-03-01T10:00:00+02:00'
        ELSE '2026-03-01T10:00:00.123Z' END AS completed_at,
    CASE WHEN updated % 3 = 0 THEN concat('{{"requests": 1, "inputTokens": ', CASE updated % 4 WHEN 0 THEN '-1' WHEN 1 THEN '1.5' WHEN 2 THEN 'null'
        ELSE '7' END, ', "outputTokens": 1, "thoughtTokens": 0, "toolTokens": 0, "cachedTokens": 0, "totalTokens": 8, "estimatedCostUsd": ', CASE updated % 5
        WHEN 0 THEN '"free"' ELSE '0.25' END, '}}') END AS usage FROM manifest_view"""

PLANS = {
    "d01_scan_documents": (lambda v: d.classify_files(v("files")).select("path", "verdict"), f"""
        SELECT path, CASE WHEN path LIKE 'root/node_modules/%' THEN 'excluded' WHEN path LIKE 'root/.%' THEN 'hidden'
          WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('pdf','png','jpg','jpeg','webp','gif','heic','heif') THEN 'supported'
              ELSE 'unsupported' END AS verdict FROM files"""),
    "d02_apply_excludes": (lambda v: d.apply_excludes(v("files"), PATTERNS).select("path"), "SELECT path FROM files WHERE NOT (path LIKE 'root/drafts/%' OR path LIKE '%.txt' OR regexp_matches(path, '^root/src1/[^/]*$'))"),
    "d03_unmatched_excludes": (lambda v: d.unmatched_excludes(v("files"), PATTERNS), """
        SELECT pattern FROM (SELECT 'drafts/**' AS pattern, bool_or(path LIKE 'root/drafts/%') AS m FROM files UNION ALL
            SELECT '**/*.txt', bool_or(path LIKE '%.txt') FROM files
          UNION ALL SELECT 'no-such/*', false UNION ALL SELECT 'root/src1/*', bool_or(regexp_matches(path, '^root/src1/[^/]*$')) FROM files) WHERE NOT m"""),
    "d04_skip_report": (lambda v: d.skip_report(d.classify_files(v("files")).where("verdict <> 'supported'").select(F.col("verdict").alias("reason"), F.col("path").alias("name"))), """
        WITH x AS (SELECT path AS name, CASE WHEN path LIKE 'root/node_modules/%' THEN 'excluded' WHEN path LIKE 'root/.%' THEN 'hidden'
            WHEN path LIKE '%.txt' THEN 'unsupported' ELSE 'supported' END AS reason FROM files)
        SELECT reason, count(*) AS count, array_to_string(list_slice(list_sort(list(name)), 1, 3), ', ') AS names FROM x WHERE reason <> 'supported' GROUP BY reason"""),
    "d05_dedupe_inputs": (lambda v: d.dedupe_inputs(v("files")), "SELECT path, min(path) OVER (PARTITION BY identity) AS kept, path <> min(path) OVER (PARTITION BY identity) AS duplicate FROM files"),
    "d06_check_media": (lambda v: d.check_media(_media(v)), _MEDIA_SQL),
    "d06_binary_pages": (lambda v: d.binary_pages(v("pages")).select("page_id", "binary"), """
        SELECT page_id, contains(html, chr(0)) OR length(html) - length(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]', '',
            'g')) > 0.01 * length(html) AS "binary" FROM pages"""),
    "d07_check_budget": (lambda v: d.check_budget(v("files")), "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) <= 1000 AS files_ok, sum(size) <= 5368709120 AS bytes_ok FROM files"),
    "d08_media_support": (lambda v: d.media_support(_mime(v), _PROVIDERS), """
        WITH m AS (SELECT path, CASE WHEN path LIKE '%.PDF' THEN 'application/pdf' WHEN path LIKE '%.png' THEN 'image/png' ELSE 'text/plain' END AS mime FROM files)
        SELECT path, provider, CASE WHEN mime = 'application/pdf' THEN pdfs <> 'false' ELSE images IS NULL OR list_contains(images, mime) END AS supported
        FROM m CROSS JOIN (VALUES ('any', NULL::VARCHAR[], 'true'), ('images-only', NULL, 'false'), ('png-only', ['image/png'], 'unknown'), ('jpeg',
            ['image/jpeg', 'image/webp'], 'model-dependent')) AS p(provider, images, pdfs)"""),
    "d09_plan_output_paths": (_planned, f"WITH {_PLANNED} SELECT path, format, target FROM planned"),
    "d10_output_collisions": (lambda v: d.output_collisions(_planned(v), ["out/summary.json", "OUT/src1"]), f"""
        WITH {_PLANNED}, k AS (SELECT lower(target) AS key FROM planned UNION ALL SELECT unnest(['out/summary.json', 'out/src1'])), c AS (SELECT key,
            count(*) AS owners FROM k GROUP BY key),
        par AS (SELECT array_to_string(list_slice(string_split(key, '/'), 1, i), '/') AS parent, owners
            FROM (SELECT key, owners, unnest(range(1, len(string_split(key, '/')))) AS i FROM c)),
        pc AS (SELECT parent, sum(owners) AS below FROM par GROUP BY parent)
        SELECT key AS target, 'same-path' AS kind, owners FROM c WHERE owners > 1
        UNION ALL SELECT key, 'file-and-folder', CAST(owners + below AS BIGINT) FROM c JOIN pc ON key = parent"""),
    "d11_occupied_targets": (lambda v: d.occupied_targets(v.sql("SELECT source, concat('out/', CAST(doc_id AS VARCHAR(20)), '.md') AS target FROM inputs_view"), v("existing_files"), _manifest(v)), """
        SELECT i.source, concat('out/', CAST(doc_id AS VARCHAR(20)), '.md') AS target FROM inputs_view i
        WHERE concat('out/', CAST(doc_id AS VARCHAR(20)), '.md') IN (SELECT path FROM existing_files)
          AND NOT EXISTS (SELECT 1 FROM manifest_view m WHERE m.source = i.source AND m.output_file = concat('out/', CAST(i.doc_id AS VARCHAR(20)), '.md'))"""),
    "d12_write_artifacts": (_written_artifacts, f"""
        WITH r AS ({_RESULTS}), f AS (SELECT concat(target, '.md') AS file, CASE WHEN ends_with(markdown, chr(10)) THEN markdown ELSE concat(markdown,
            chr(10)) END AS body FROM r WHERE markdown <> ''
          UNION ALL SELECT concat(target, '.json'), concat('{{', chr(10), '  "id": ', json ->> 'id', ',', chr(10), '  "lang": "', json ->> 'lang', '",',
              chr(10), '  "tags": [', chr(10), '    "a"', chr(10), '  ]', chr(10), '}}', chr(10)) FROM r WHERE json IS NOT NULL
          UNION ALL SELECT concat(target, '.csv'), csv FROM r WHERE csv IS NOT NULL)
        SELECT file, length(body) AS chars, sha256(body) AS sha FROM f"""),
    "d13_chunk_artifacts": (lambda v: d.chunk_artifacts(v("documents"), max_bytes=1000), """
        WITH RECURSIVE d AS (SELECT doc_id AS id, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS total FROM documents),
          c AS (SELECT id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS "offset", least(total, 1000 - CASE WHEN total <= 1000 OR substr(h, 2001,
              1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 1999, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 1997, 1) NOT IN ('8', '9', 'A',
              'B') THEN 2 ELSE 3 END) AS next_offset, total FROM d
            UNION ALL SELECT c.id, chunk_no + 1, next_offset, least(d.total, next_offset + 1000 - CASE WHEN d.total <= next_offset + 1000 OR substr(h,
                2 * (next_offset + 1000) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0
              WHEN substr(h, 2 * (next_offset + 999) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 2 * (next_offset + 998) + 1, 1) NOT IN ('8',
                  '9', 'A', 'B') THEN 2 ELSE 3 END), d.total FROM c JOIN d ON c.id = d.id WHERE next_offset < d.total)
        SELECT c.id, chunk_no, "offset", next_offset, c.total, next_offset = c.total AS eof, decode(unhex(substr(h, 2 * "offset" + 1,
            2 * (next_offset - "offset")))) AS chunk FROM c JOIN d ON c.id = d.id"""),
    "r01_fingerprint": (lambda v: r.fingerprint(v.sql("SELECT source, size, CAST(text AS BINARY) AS content, doc_id AS mtime FROM inputs_view"), '{"mode":"simple"}'), """
        SELECT source, sha256(concat('v2', chr(0), source, chr(0), CAST(size AS VARCHAR), chr(0), sha256(text), chr(0), '{"mode":"simple"}')) AS v2,
               sha256(concat(source, chr(0), CAST(size AS VARCHAR), chr(0), CAST(doc_id AS VARCHAR), chr(0), '{"mode":"simple"}')) AS v1, left(sha256(source),
                   16) AS document_id FROM inputs_view"""),
    "r01_duplicate_ids": (lambda v: r.duplicate_ids(v.sql("SELECT source, size, CAST(text AS BINARY) AS content FROM inputs_view").select("source", F.substring(F.sha2("content", 256), 1, 16).alias("document_id"))), """
        SELECT left(sha256(text), 16) AS document_id, count(*) AS sources FROM inputs_view GROUP BY 1 HAVING count(*) > 1"""),
    "r02_plan_incremental": (lambda v: r.plan_incremental(v("inputs_view").select("source", "fingerprint", "legacy_fingerprint"), _manifest(v), v("existing_files")), None),
    "r03_upgrade_legacy": (lambda v: r.upgrade_legacy(r.plan_incremental(v("inputs_view").select("source", "fingerprint", "legacy_fingerprint"), _manifest(v), v("existing_files")), _manifest(v)).select("source", "fingerprint", "fingerprint_version", "status"), None),
    "r04_claim_pending": (lambda v: r.claim_pending(r.plan_incremental(v("inputs_view").select("source", "fingerprint", "legacy_fingerprint"), _manifest(v), v("existing_files")), _manifest(v)).select("source", "fingerprint", "status", "queued", F.array_join("owned_files", ",").alias("owned"), "error"), None),
    "r05_merge_manifest": (lambda v: r.merge_manifest(_manifest(v).select("source", "fingerprint", "status", "output_files", "owned_files", "updated"), _updates(v)).select("source", "fingerprint", "status", F.array_join("output_files", ",").alias("outputs"), F.array_join("owned_files", ",").alias("owned"), "updated"), """
        WITH u AS (SELECT source, 'new' AS fingerprint, 'succeeded' AS status, concat('out/new-', CAST(doc_id AS VARCHAR), '.md') AS o, concat('out/new-',
            CAST(doc_id AS VARCHAR), '.md') AS w, doc_id + 10 AS updated FROM inputs_view WHERE doc_id % 4 = 1
                   UNION ALL SELECT source, fingerprint, status, CASE WHEN status = 'pending' THEN '' ELSE output_file END, output_file, updated FROM manifest_view)
        SELECT source, arg_max(fingerprint, updated) AS fingerprint, arg_max(status, updated) AS status, arg_max(o, updated) AS outputs,
            array_to_string(list_sort(list_distinct(list(w))), ',') AS owned, max(updated) AS updated FROM u GROUP BY source"""),
    "r06_settle_claims": (lambda v: r.settle_claims(_manifest(v).select("source", "fingerprint", "status", "queued"), v.sql("SELECT source, 'before' AS fingerprint, 'failed' AS status, false AS queued FROM inputs_view WHERE doc_id % 2 = 0"), v.sql("SELECT source FROM inputs_view WHERE doc_id % 5 = 0")), """
        SELECT source, fingerprint, status, queued FROM manifest_view m WHERE NOT (status = 'pending' AND queued AND source NOT IN (SELECT source
            FROM inputs_view WHERE doc_id % 5 = 0))
        UNION ALL SELECT i.source, 'before', 'failed', false FROM inputs_view i JOIN manifest_view m ON i.source = m.source
            WHERE i.doc_id % 2 = 0 AND m.status = 'pending' AND m.queued AND i.doc_id % 5 <> 0"""),
    "r07_batch_status": (lambda v: r.batch_status(_manifest(v), v("existing_files"), v.sql("SELECT source AS path FROM inputs_view WHERE doc_id % 13 <> 0")), _STATUS_SQL.format(sums="", counts="""
          count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'partial') AS partial,
              count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped""", extra="FROM m, (SELECT false AS last_run_incomplete, true AS last_run_ok) l", more="")),
    "r07_batch_status_by_summary": (lambda v: r.batch_status(_manifest(v), v("existing_files"), v.sql("SELECT source AS path FROM inputs_view"), v("results").where("run_id = 3")), _STATUS_SQL.format(sums="""l AS (SELECT count(*) AS n, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'skipped') AS k,
          count(*) FILTER (status = 'skipped' AND coalesce(skip_reason, '') NOT IN ('resumed', 'validated')) > 0 AS last_run_incomplete,
              count(*) FILTER (status IN ('failed', 'partial')) = 0 AND count(*) FILTER (status = 'skipped' AND coalesce(skip_reason, '') NOT IN ('resumed',
              'validated')) = 0 AS last_run_ok FROM results WHERE run_id = 3),""",
        counts="any_value(n) AS total, any_value(s) AS succeeded, any_value(p) AS partial, any_value(f) AS failed, any_value(k) AS skipped", extra="FROM m, l", more=" OR true")),
    "r08_audit_outputs": (lambda v: r.audit_outputs(v("existing_files"), _manifest(v)), """
        SELECT path, 'untracked' AS kind FROM existing_files WHERE regexp_matches(path, '\\.(md|csv|json)$') AND path NOT IN (SELECT output_file FROM manifest_view)
          AND regexp_replace(path, '\\.(md|csv|json)$', '') IN (SELECT regexp_replace(output_file, '\\.md$', '') FROM manifest_view)
        UNION ALL SELECT path, 'stray' FROM existing_files WHERE path LIKE '%.tmp'"""),
    "r09_check_manifest": (lambda v: r.check_manifest(v.sql(_ENTRIES.format(none="array()", blank="array('')", own="array(output_file)"))), f"""
        WITH m AS ({_ENTRIES.format(none="[]", blank="['']", own="[output_file]")})
        SELECT source, 'unknown-status' AS issue FROM m WHERE status = 'done' UNION ALL SELECT source, 'empty-fingerprint' FROM m WHERE trim(fingerprint) = ''
        UNION ALL SELECT source, 'no-outputs' FROM m WHERE status IN ('succeeded', 'partial') AND len(output_files) = 0 UNION ALL
            SELECT source, 'empty-output-path' FROM m WHERE list_contains(output_files, '')
        UNION ALL SELECT source, 'queued-not-pending' FROM m WHERE queued AND status <> 'pending' UNION ALL SELECT source, 'bad-version' FROM m
            WHERE fingerprint_version IS NOT NULL AND fingerprint_version <> 2
        UNION ALL SELECT source, 'bad-time' FROM m WHERE completed_at IS NULL OR NOT regexp_full_match(completed_at,
            '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+(Z|[+-][0-9:]+)') OR try_cast(completed_at AS TIMESTAMPTZ) IS NULL
        UNION ALL SELECT source, 'bad-usage' FROM m WHERE usage IS NOT NULL AND (usage ->> 'inputTokens' IS NULL
            OR TRY_CAST(usage ->> 'inputTokens' AS DOUBLE) < 0 OR TRY_CAST(usage ->> 'inputTokens' AS DOUBLE) % 1 <> 0 OR json_type(usage,
            '$.estimatedCostUsd') = 'VARCHAR')"""),
}

_PLAN_SQL = """plan AS (SELECT i.source, i.doc_id, i.fingerprint, m.source AS m_source, m.fingerprint_version, m.status, m.output_file, m.queued,
          coalesce(m.fingerprint <> i.fingerprint AND m.fingerprint_version IS NULL AND m.fingerprint = i.legacy_fingerprint, false) AS legacy,
          CASE WHEN m.source IS NULL THEN 'new' WHEN m.status <> 'succeeded' THEN m.status
               WHEN m.fingerprint <> i.fingerprint AND NOT (m.fingerprint_version IS NULL AND m.fingerprint = i.legacy_fingerprint) THEN 'changed'
               WHEN m.output_file NOT IN (SELECT path FROM existing_files) THEN 'missing-output' ELSE 'unchanged' END AS reason
        FROM inputs_view i LEFT JOIN manifest_view m ON i.source = m.source)"""
_PLAN_ORACLES = {"r02_plan_incremental": f"WITH {_PLAN_SQL} SELECT source, fingerprint, CASE WHEN reason = 'unchanged' THEN 'resume' ELSE 'extract' END AS action, reason, legacy AND reason = 'unchanged' AS legacy FROM plan",
    "r03_upgrade_legacy": f"WITH {_PLAN_SQL} SELECT source, fingerprint, 2 AS fingerprint_version, status FROM plan WHERE legacy AND reason = 'unchanged'",
    "r04_claim_pending": f"WITH {_PLAN_SQL} SELECT source, fingerprint, 'pending' AS status, true AS queued, output_file AS owned, CASE WHEN status = 'failed' THEN concat('failed: ', source) END AS error FROM plan WHERE reason <> 'unchanged'",}
PLANS |= {k: (PLANS[k][0], sql) for k, sql in _PLAN_ORACLES.items()}


def _media(v: Inputs):
    """Documents with the signatures of media types in front, some of them not the declared one."""
    head = F.unhex(F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int")))
    declared = F.get(F.array(*map(F.lit, _KINDS)), (F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")) % len(_KINDS)).cast("int"))
    return (v("documents")
        .select(F.col("doc_id").cast("string").alias("path"), declared.alias("declared"), "n_chars",
            F.concat(head, F.col("text").cast("binary")).alias("content"))
        .select("path", "declared", F.octet_length("content").cast("long").alias("size"), "content"))
