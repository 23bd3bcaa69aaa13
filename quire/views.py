"""Operator inputs derived from the driver tables, in SQL that Spark and DuckDB both run.

``{g}`` is the global flag of ``regexp_replace``, which DuckDB wants spelled out; ``{rows}`` joins the ordered lines of a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "ref_fields": """
        SELECT o_orderkey AS doc_id, 'invoice_number' AS field, concat('INV-', CAST(o_orderkey AS VARCHAR(20))) AS value FROM orders
        UNION ALL SELECT o_orderkey, 'invoice_date', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) FROM orders
        UNION ALL SELECT o_orderkey, 'customer_name', c_name FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT o_orderkey, 'total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) FROM orders""",
    "pred_fields": """
        SELECT doc_id, field, CASE WHEN (doc_id + length(field)) % 13 = 0 THEN concat(value, 'x') ELSE value END AS value,
               CAST((doc_id % 100) AS DOUBLE) / 100 AS confidence
        FROM ref_fields WHERE (doc_id * 31 + length(field)) % 11 <> 0
        UNION ALL SELECT o_orderkey, 'invented', 'Acme', 0.5 FROM orders WHERE o_orderkey % 17 = 0""",
    "ref_cells": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_no, 'quantity' AS column_name, CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS value
            FROM lineitem
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), 'line_total', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) FROM lineitem""",
    "pred_cells": """
        SELECT doc_id, row_no, CASE WHEN (doc_id + row_no) % 19 = 0 THEN 'surplus' ELSE column_name END AS column_name,
               CASE WHEN (doc_id * 7 + row_no) % 10 = 0 THEN '' WHEN (doc_id + row_no) % 9 = 0 THEN concat(value, '0') ELSE value END AS value
        FROM ref_cells WHERE (doc_id + row_no * 3) % 8 <> 0""",
    "text_pairs": """
        SELECT doc_id, reference, said, CASE WHEN doc_id % 3 = 0 THEN concat('# **', said, '**', chr(10), chr(10), '> [the end](http://h/) ')
            WHEN doc_id % 3 = 1 THEN concat('```text', chr(10), said, chr(10), '```', chr(10), '- `the` ![end](x)') ELSE concat(said,
            ' the<br/>end') END AS prediction
        FROM (SELECT doc_id, text AS reference, trim(replace(replace(text, 'th', 'tn'), 'er ', ' ')) AS said FROM documents) damaged""",
    "presence_view": """
        SELECT *, CASE WHEN doc_id % 5 = 0 AND text = regexp_replace(text, '[^ -~]', ''{g}) THEN 2 ELSE 0 END AS max_diffs
        FROM (SELECT doc_id AS test_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'present' ELSE 'absent' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'zzqq yy'
            WHEN doc_id % 15 = 5 THEN concat(substr(reference, 5, 3), 'q', substr(reference, 9, 6)) ELSE substr(reference, 5, 6) END AS text,
                doc_id % 7 <> 0 AS case_sensitive, CASE WHEN doc_id % 4 IN (0, 2) THEN 100 END AS first_n, CASE WHEN doc_id % 4 IN (1,
                    2) THEN 150 END AS last_n FROM text_pairs) needles""",
    "order_view": """
        SELECT *, CASE WHEN doc_id % 5 < 2 AND concat(before, after) = regexp_replace(concat(before, after), '[^ -~]', ''{g}) THEN 1 ELSE 0 END AS max_diffs
        FROM (SELECT doc_id AS test_id, doc_id, 'order' AS type, CASE WHEN doc_id % 5 = 1 THEN concat('q', substr(reference, 20, 6)) ELSE substr(reference,
            CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END, 4) END AS before, right(reference, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 5 END) AS after
              FROM text_pairs) anchors""",
    "manifest_view": """
        SELECT concat('/corpus/', CAST(doc_id AS VARCHAR(20)), '.pdf') AS source,
               CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE concat('fp-', CAST(n_chars AS VARCHAR(20))) END AS fingerprint,
               CASE doc_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'succeeded' END AS status,
               (doc_id % 10 = 2) AS queued, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 2 END AS fingerprint_version,
               concat('out/', CAST(doc_id AS VARCHAR(20)), '.md') AS output_file, doc_id AS updated
        FROM documents WHERE doc_id % 3 <> 0""",
    "inputs_view": """
        SELECT concat('/corpus/', CAST(doc_id AS VARCHAR(20)), '.pdf') AS source, concat('fp-', CAST(n_chars AS VARCHAR(20))) AS fingerprint,
               CASE WHEN doc_id % 14 = 0 THEN 'stale' ELSE 'old' END AS legacy_fingerprint, doc_id, source AS folder, n_chars AS size, text
        FROM documents""",
    "existing_files": """
        SELECT concat('out/', CAST(doc_id AS VARCHAR(20)), '.md') AS path FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT concat('out/', CAST(doc_id AS VARCHAR(20)), '.csv') FROM documents WHERE doc_id % 23 = 0
        UNION ALL SELECT concat('out/.', CAST(doc_id AS VARCHAR(20)), '-0a1b2c3d-0000-4000-8000-00000000000f.tmp') FROM documents WHERE doc_id % 37 = 0""",
    "usage_log": """
        SELECT event_id AS request_id, user_id % 8 AS job_id, ts, CASE WHEN event_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
               CAST(floor(value * 1000) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
               CAST(floor(value * 100) AS BIGINT) AS cached_tokens, event_id % 5 AS thought_tokens, event_id % 29 <> 0 AS reported,
               CASE WHEN event_id % 10 = 0 THEN CAST((event_id % 70) / 1000.0 AS DECIMAL(12,6)) END AS exact_cost,
               CASE WHEN event_id % 13 = 0 THEN 'openai-compatible' ELSE 'named' END AS provider, event_id % 3 = 0 AS thoughts_in_output,
               CASE WHEN event_id % 17 < 2 THEN CAST(3.25 AS DECIMAL(10,4)) END AS custom_input, CASE
                   WHEN event_id % 17 = 0 THEN CAST(9.0001 AS DECIMAL(10,4)) END AS custom_output
        FROM events""",
    "case_results": """
        SELECT o_orderkey % 200 AS case_id, o_orderpriority AS route,
               CASE o_custkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'template' ELSE 'agentic' END AS mode,
               o_orderstatus AS tag, CAST(floor(o_orderkey / 200.0) AS BIGINT) AS repeat_no, 1 + o_custkey % 2 AS weight,
               o_orderkey % 6 <> 0 AS passed, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS metric, CASE o_custkey % 4 WHEN 0 THEN 'tables'
                   WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS tag2,
               CASE WHEN o_orderkey % 10 > 0 THEN 100 + o_custkey % 900 END AS duration_ms, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey * 3 END AS tokens, CASE
                   WHEN o_orderkey % 8 > 0 THEN CAST((o_orderkey % 50) / 1000.0 AS DECIMAL(10,4)) END AS cost
        FROM orders""",
    "md_docs": """
        SELECT l_orderkey AS doc_id, concat('# Invoice ', CAST(l_orderkey AS VARCHAR(20)), chr(10), chr(10), '| line | quantity |', chr(10), '| --- | --- |',
            {rows}) AS text
        FROM (SELECT l_orderkey, l_linenumber, concat(chr(10), '| ', CAST(l_linenumber AS VARCHAR(20)), ' | ', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)),
            ' |') AS line FROM lineitem) r GROUP BY l_orderkey""",
    "order_json": """
        SELECT l_orderkey AS doc_id, concat('{"id": ', CAST(l_orderkey AS VARCHAR(20)), CASE WHEN l_orderkey % 9 = 0 THEN ', "odd": 1' ELSE '' END,
            ', "items": [', substr({rows}, 2), ']}') AS json
        FROM (SELECT l_orderkey, l_linenumber, concat(',{', CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('"price": ', CASE WHEN l_partkey % 7 = 0 THEN '-'
            ELSE '' END, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)), ', ') END,
                CASE WHEN l_linenumber = 6 THEN '"extra": null, ' ELSE '' END, '"qty": ', CASE WHEN l_suppkey % 11 = 0 THEN '"many"'
                    ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END, ', "tags": ["a"', CASE WHEN l_partkey % 13 = 0 THEN ', 5' ELSE '' END, ', "',
                    l_returnflag, '"]}') AS line FROM lineitem) r
        GROUP BY l_orderkey""",
    "run_events": """
        SELECT user_id % 4 AS run_id, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) + CASE WHEN event_id % 97 = 0 THEN 1
            ELSE 0 END AS BIGINT) AS sequence,
               ts, user_id AS document_id,
               CASE WHEN event_id % 1009 = 1008 THEN 'run.completed' ELSE CASE event_type WHEN 'signup' THEN 'document.started'
                   WHEN 'view' THEN 'document.progress' WHEN 'purchase' THEN 'document.completed'
                               WHEN 'error' THEN 'document.failed' ELSE 'document.partial' END END AS type
        FROM events""",
    "attempts": """
        SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempt,
               CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 ELSE 200 END AS status_code,
               CASE WHEN event_id % 4 = 0 THEN event_id % 90 END AS retry_after_s, CASE WHEN user_id % 6 = 0 THEN 'agentic' ELSE 'simple' END AS mode,
                   value > 90 AND event_id % 4 = 0 AS quota_exhausted
        FROM events""",
    "url_list": """
        SELECT page_id * 5 AS pos, url FROM pages
        UNION ALL SELECT page_id * 5 + 1, concat(url, '/') FROM pages WHERE page_id % 9 = 0
        UNION ALL SELECT page_id * 5 + 2, CASE page_id % 4 WHEN 0 THEN concat('http://localhost/', CAST(page_id AS VARCHAR(20)))
            WHEN 1 THEN concat('http://10.0.0.', CAST(page_id % 200 AS VARCHAR(20)), '/x')
                                 WHEN 2 THEN concat('https://a', CAST(page_id AS VARCHAR(20)), '.ngrok.io/y') ELSE concat('ftp://h/', CAST(page_id AS VARCHAR(20))) END
                  FROM pages WHERE page_id % 13 = 0
        UNION ALL SELECT page_id * 5 + 3, regexp_replace(regexp_replace(url, '^(https://[^/]+)', CASE WHEN page_id % 2 = 0 THEN '{1}:443' ELSE '{1}:8443' END),
            '/([^/]+)$', '/./x/../{1}#part') FROM pages WHERE page_id % 5 = 0
        UNION ALL SELECT page_id * 5 + 4, concat(CASE page_id % 3 WHEN 0 THEN 'http://' WHEN 1 THEN 'HTTPS://' ELSE 'http:/' END,
                    CASE page_id % 11 WHEN 0 THEN CAST(2130706433 + page_id AS VARCHAR(20)) WHEN 1 THEN '127.1' WHEN 2 THEN '0x7f.0.0.1'
                        WHEN 3 THEN '0177.0.0.01' WHEN 4 THEN '08.8.8.8' WHEN 5 THEN '134744072' WHEN 6 THEN '300.1' WHEN 7 THEN '1.2.3.4.5'
                                      WHEN 8 THEN 'user@Example.org:80' WHEN 9 THEN '192.11010307' ELSE '0xA9FEA9FE' END, '/p/',
                                          CAST(page_id % 7 AS VARCHAR(20))) FROM pages WHERE page_id % 2 = 1""",
    "candidates": """
        SELECT doc_id, s.seq AS seq, field, CASE WHEN s.seq = 2 THEN concat(value, '2') ELSE value END AS value,
               CAST((doc_id * s.seq) % 100 AS DOUBLE) / 100 AS confidence, (doc_id + s.seq) % 4 <> 0 AS is_valid, (doc_id * 7 + s.seq) % 3 AS extracted_at,
               CASE WHEN (doc_id + s.seq) % 3 = 0 THEN doc_id % 5 + s.seq END AS page
        FROM pred_fields CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) s""",
    "files": """
        SELECT concat('root/', CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'drafts/' ELSE '' END, source, '/',
                      CASE WHEN doc_id % 19 = 0 THEN 'AGENTS' ELSE CAST(doc_id AS VARCHAR(20)) END,
                      CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.png' END) AS path,
               n_chars AS size, concat('id-', CAST(doc_id - doc_id % 2 AS VARCHAR(20))) AS identity
        FROM documents""",
    "results": """
        SELECT o_custkey % 20 AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS doc_id,
               CASE WHEN o_custkey % 20 = 5 THEN 'skipped' WHEN o_custkey % 20 = 6 THEN CASE WHEN o_orderkey % 23 = 2 THEN 'skipped' ELSE 'failed' END ELSE
                   CASE o_orderkey % 23 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'skipped' ELSE 'succeeded' END END AS status,
               CASE WHEN o_custkey % 20 = 5 THEN 'validated' WHEN o_orderkey % 23 = 2 THEN CASE o_custkey % 20 WHEN 3 THEN 'cost-limit' WHEN 4 THEN 'cancelled'
                   WHEN 6 THEN 'failed-fast' ELSE 'resumed' END END AS skip_reason, CAST((o_orderkey % 50) / 1000.0 AS DECIMAL(10,4)) AS cost,
                   o_orderkey % 29 <> 0 AS reported,
               CASE o_custkey % 31 WHEN 0 THEN 'partial' WHEN 1 THEN 'max_iterations' WHEN 2 THEN 'tool_limit_reached' WHEN 3 THEN 'budget_exhausted'
                   WHEN 4 THEN 'cost_limit_reached' WHEN 5 THEN 'confused' WHEN 6 THEN 'succeeded' END AS stop_reason
        FROM orders""",
    "steps": """
        SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 4 = 3 THEN 'function_call' ELSE 'thinking' END AS type,
               CASE WHEN turn % 5 = 4 THEN 'runtime' ELSE 'reasoning' END AS source, turn % 4 <> 3 AS is_delta, text AS content,
               CASE WHEN turn % 9 < 8 THEN CAST(floor(turn / 3.0) AS BIGINT) END AS id, turn % 7 = 6 AS has_call
        FROM conversations""",
}


def needed(sql: str) -> list[str]:
    """The views that ``sql`` uses, directly or not, in an order they can be defined in."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


class Inputs:
    """The driver tables and derived views of one folder, as DataFrames by name; ``given`` tables stand for those of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self.given = spark, sf_dir, given or {}

    def __call__(self, name: str) -> DataFrame:
        return self.table(name) if name in TABLES else self.sql(f"SELECT * FROM {name}")

    def table(self, name: str) -> DataFrame:
        return self.given[name] if name in self.given else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        """``query`` over tables and views."""
        views = needed(query)
        text = with_views(query, views, "")
        frames = {t: self.table(t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)}
        names = {t: f"quire_{abs(hash(self.sf_dir)):x}_{t}" for t in frames}
        for t, frame in frames.items():
            frame.createOrReplaceTempView(names[t])
            text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{names[t]}", text)
        return self.spark.sql(text)


def with_views(query: str, views: Iterable[str] | None = None, g: str = ", 'g'") -> str:
    """``query`` with the views it uses in front, as common table expressions."""
    views = needed(query) if views is None else views
    rows = "string_agg(line, '' ORDER BY l_linenumber, line)" if g else "listagg(line, '') WITHIN GROUP (ORDER BY l_linenumber, line)"
    parts = [f"{v} AS ({VIEWS[v].replace('{g}', g).replace('{rows}', rows).replace('{1}', chr(92) + '1' if g else '$1')})" for v in views]
    body = query.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
