"""Queries of preset fields (T), document structure (M) and candidate fields (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import candidates as a
from quire.operators import presets as t
from quire.operators import structure as m
from quire.views import Inputs

_RULES = [(1, "invoice_number", "text", True, "^INV-[0-9]+$"), (2, "invoice_date", "date", True, None), (3, "customer_name", "text", True, None),
    (4, "total", "currency", True, None), (5, "total", "number", False, None)]
_RULE_SQL = "(VALUES ('invoice_number', true, '^INV-[0-9]+$'), ('invoice_date', true, NULL), ('customer_name', true, NULL), ('total', true, NULL)) AS r(field, required, pattern)"
# printed amounts put together from their parts: style, whole part, three digits and two
_AMOUNTS = """SELECT o_orderkey AS doc_id, 'total' AS field, style, w, lpad(CAST(d AS VARCHAR(20)), 3, '0') AS d, lpad(CAST(f AS VARCHAR(20)), 2, '0') AS f, CAST(o_orderkey % 110 - 5 AS DOUBLE) / 100 AS confidence, CASE o_custkey % 4 WHEN 0 THEN 'KWD' WHEN 1 THEN 'EUR' END AS currency
    FROM (SELECT *, o_orderkey % 19 AS style, o_custkey % 900 + 1 AS w, o_custkey % 1000 AS d, o_orderkey % 100 AS f FROM orders) q"""
_PRINTED = """SELECT doc_id, field, confidence, currency, style, w, d, f, CASE style WHEN 0 THEN concat('$', w, ',', d, '.', f) WHEN 1 THEN concat('(', w, ')') WHEN 2 THEN concat('EUR ', w, '.', d, ',', f) WHEN 3 THEN concat('Rs.', w) WHEN 4 THEN concat('No.', w) WHEN 5 THEN concat(w, '.', d)
    WHEN 6 THEN concat('3 @ ', w, '.00') WHEN 7 THEN concat(w, '.', f, '-') WHEN 8 THEN concat(w, ' ', d, ',', f) WHEN 9 THEN concat(w, chr(39), d, '.', f)
        WHEN 10 THEN concat('-$', w, '.', f) WHEN 11 THEN concat(translate(CAST(w AS VARCHAR(20)), '0123456789', '０１２３４５６７８９'), '.', f)
        WHEN 12 THEN concat('−', w, ',', f)
    WHEN 13 THEN concat(w, ',', d, ',', d) WHEN 14 THEN concat(w, ',', f, ',', d) WHEN 15 THEN concat('.', f, ' USD') WHEN 16 THEN concat('S/.', w, '.', f)
        WHEN 17 THEN 'to be agreed' ELSE concat(' ', w, ' ') END AS value FROM (SELECT doc_id, field, confidence, currency, style, CAST(w AS VARCHAR(20)) AS w,
        d, f FROM amounts) a"""
_TYPED = """SELECT o_orderkey AS doc_id, 'when' AS field, CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) WHEN 1 THEN '2024-02-30' WHEN 2 THEN '12/01/26' ELSE '2024-02-29T10:00' END AS value FROM orders
    UNION ALL SELECT o_orderkey, 'mail', CASE o_orderkey % 3 WHEN 0 THEN 'a@b.org' WHEN 1 THEN 'mailto:x@y.co' ELSE 'no at' END FROM orders
    UNION ALL SELECT o_orderkey, 'site', CASE o_orderkey % 5 WHEN 0 THEN 'https://e.org/x' WHEN 1 THEN 'javascript:1' WHEN 2 THEN 'e.org:80/x'
        WHEN 3 THEN 'http://u@h.org' ELSE 'just text' END FROM orders"""
_ITEMS = """SELECT l_orderkey AS doc_id, concat('item_', CAST(l_linenumber AS VARCHAR(20)), '_amount') AS field, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) AS value FROM lineitem
    UNION ALL SELECT l_orderkey, 'subtotal', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(40))
        FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey, 'item_count', CAST(count(*) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) FROM lineitem GROUP BY l_orderkey"""
_DATES = """SELECT o_orderkey AS doc_id, 'invoice_date' AS field, substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS value FROM orders
    UNION ALL SELECT o_orderkey, 'due_date', CASE o_orderkey % 3 WHEN 0 THEN '1990-01-01' WHEN 1 THEN '2099-12-31' ELSE '05/06/1994' END FROM orders"""
_RULED = """SELECT doc_id, field, value, CASE WHEN doc_id % 5 = 0 AND field = 'invoice_number' THEN 'number' WHEN doc_id % 7 = 0 AND field = 'total' THEN 'free' END AS rule FROM pred_fields
    UNION ALL SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'contact_phone' ELSE 'work_email' END, CASE o_custkey % 4 WHEN 0 THEN concat('+1 (555) ',
        CAST(1000000 + o_custkey AS VARCHAR(20))) WHEN 1 THEN concat('u', CAST(o_custkey AS VARCHAR(20)), '@h.org') WHEN 2 THEN '555-1234' ELSE 'n/a' END, ' '
        FROM orders"""
_LAYOUT = "SELECT l_orderkey AS doc_id, CASE l_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'stamp' END AS feature FROM lineitem UNION ALL SELECT l_orderkey, 'line' FROM lineitem"
_REGIONS = "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 4 AS DOUBLE) AS page, CAST(o_custkey % 12 AS DOUBLE) / 10 AS x, CAST(o_custkey % 5 AS DOUBLE) / 4 AS y, 0.25 AS width, CAST(o_orderkey % 3 AS DOUBLE) / 4 AS height, CASE WHEN o_orderkey % 10 = 0 THEN 'px' ELSE 'normalized' END AS units FROM orders"
_NAMED = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Bill' WHEN 1 THEN ' Receipts ' WHEN 2 THEN 'Memo & Note' WHEN 3 THEN ' ' WHEN 4 THEN 'Curriculum-Vitae' ELSE 'purchase_order' END AS document_type, CASE field WHEN 'total' THEN 'Grand Total' WHEN 'customer_name' THEN 'Bill-To' ELSE field END AS field, value FROM pred_fields"
_REQUIRED = [("invoice", f) for f in ("invoice_number", "invoice_date", "customer_name", "total")] + [("form", None)]
_PASSES = "SELECT o_orderkey AS doc_id, i AS iteration, CASE WHEN i = 1 + o_orderkey % 3 THEN CASE o_orderkey % 2 WHEN 0 THEN 'no-progress' ELSE 'confidence-and-coverage-met' END END AS stop_reason FROM orders CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE i <= 1 + o_orderkey % 3"
_TYPES = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'form' ELSE 'unknown' END AS document_type FROM orders"


def _rules(v: Inputs):
    return v.spark.createDataFrame(_RULES, "pos int, field string, type string, required boolean, pattern string")


def _one_rule_each(v: Inputs):
    return _rules(v).where("pos < 5")


def _typed_rules(v: Inputs):
    return v.spark.createDataFrame([("when", "date"), ("mail", "email"), ("site", "url")], "field string, type string")


def _columns(v: Inputs):
    return v.spark.createDataFrame([("quantity",), ("line_total",)], "column_name string")


def _docs(v: Inputs):
    return v.sql("SELECT o_orderkey AS doc_id FROM orders")


# payloads put together from choices, so that breaches meet in all combinations
_PAYLOADS = """SELECT doc_id, CASE WHEN doc_id % 17 = 16 THEN 'no json' ELSE concat('{"fields": ', CASE doc_id % 7 WHEN 0 THEN '[1]' WHEN 1 THEN concat('{"total": {"value": ', CAST(n_chars AS VARCHAR(20)), ', "confidence": ', CAST(n_chars % 30 AS VARCHAR(20)), 'e-1}}') WHEN 2 THEN '{"a": {"confidence": 0.5}, "b": 4}' WHEN 3 THEN '{"a": {"value": null, "confidence": "0.7"}, "c": {"value": "x", "confidence": "high"}}'
      WHEN 4 THEN '{}' WHEN 5 THEN '{"d": {"value": "y", "confidence": 1.04}, "e": {"value": "z", "confidence": -0.06}}' ELSE '{"f": {"value": true}}' END,
          CASE doc_id % 5 WHEN 0 THEN ', "rows": [{"q": 1}, 5]' WHEN 1 THEN ', "rows": 3' WHEN 2 THEN ', "rows": []' ELSE '' END,
      CASE doc_id % 3 WHEN 0 THEN ', "warnings": ["w"]' WHEN 1 THEN ', "warnings": [1]' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN ', "summary": 7'
          WHEN 1 THEN concat(', "documentType": "', lang, '"') ELSE '' END, '}') END AS json FROM documents"""
_OUTPUTS = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 41 = 40 THEN '{broken' ELSE concat('{', CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '"total": "x", ' ELSE concat('"total": ', CAST(o_custkey % 14 - 2 AS VARCHAR(20)), '.5, ') END, CASE o_custkey % 4 WHEN 0 THEN '"kind": "z", ' WHEN 1 THEN '"kind": "a", ' WHEN 2 THEN '"kind": 3, ' ELSE '' END,
      CASE o_orderkey % 7 WHEN 0 THEN '"party": {"name": "n", "odd": 1}, ' WHEN 1 THEN '"party": {}, ' WHEN 2 THEN '"party": [1], ' ELSE '' END,
          CASE o_custkey % 6 WHEN 0 THEN '"items": [], ' WHEN 1 THEN '"items": [1, 2, 3, 4], ' WHEN 2 THEN '"items": [1], ' ELSE '' END, '"',
          lower(o_orderstatus), '": 1}') END AS json FROM orders"""


def _order_schema(v: Inputs):
    rows = [(1, "id", "integer", True, None, None, None, None), (2, "items", "array", True, None, None, 1, 6),
        (3, "items[].price", "number", True, 0.0, None, None, None), (4, "items[].qty", "integer", False, 1.0, None, None, None),
        (5, "items[].tags[]", "string", True, None, None, None, None)]
    return v.spark.createDataFrame([(*r[:4], None, *r[4:]) for r in rows],
        "pos int, property string, type string, required boolean, enum array<string>, minimum double, maximum double, min_items int, max_items int")


def _schema(v: Inputs):
    rows = [(1, "total", "number", True, None, 0.0, 10.0, None, None), (2, "kind", "string", False, ["a", "b"], None, None, None, None),
        (3, "party", "object", True, None, None, None, None, None), (4, "party.name", "string", True, None, None, None, None, None),
        (5, "items", "array", False, None, None, None, 1, 3), (6, "o", "integer", False, None, None, None, None, None)]
    return v.spark.createDataFrame(rows, "pos int, property string, type string, required boolean, enum array<string>, minimum double, maximum double, min_items int, max_items int")


def _amounts(v: Inputs):
    rows = v.sql(f"WITH amounts AS ({_AMOUNTS}) {_PRINTED}")
    return t.normalize_fields(rows, _one_rule_each(v), t.document_currency(rows.select("doc_id", F.lit("currency").alias("field"), F.col("currency").alias("value"))))


def _broken_rules(v: Inputs):
    return v.spark.createDataFrame([(1, "invoice_number", True, "^INV-[0-9]+$"), (2, "invoice_date", True, None), (3, "customer_name", True, "([a-z"),
            (4, "total", True, "^[0-9.]+$"), (5, "tags", False, "^[a-z]+$")], "pos int, field string, required boolean, pattern string")


_TAGGED = "SELECT doc_id, field, value FROM pred_fields UNION ALL SELECT o_orderkey, 'tags', concat(lower(o_orderstatus), ',', o_orderpriority, ',x') FROM orders WHERE o_orderkey % 3 = 0"
_NOTES = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'validation' ELSE 'warning' END AS kind, concat('see ', o_orderpriority, ' | <', o_orderstatus, '>', chr(10), '`x`') AS message FROM orders WHERE o_custkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'warning', 'late' FROM orders WHERE o_custkey % 5 = 0"""


def _rendered(v: Inputs):
    docs = v.sql("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 > 0 THEN concat('Order of ', CAST(o_custkey AS VARCHAR(20))) END AS summary FROM orders")
    return t.render_markdown(docs, v("pred_fields").where("field <> 'invented'"), _one_rule_each(v), v("ref_cells").where("doc_id % 3 > 0"), ["quantity", "line_total"], v.sql(_NOTES), "Invoice")


# Markdown put together from parts: headings of both kinds, fences with headings inside, rules below paragraphs
_PARTS = """SELECT l_orderkey AS doc_id, l_linenumber AS i, l_partkey AS k, l_partkey % 4 AS kind, CAST(l_linenumber AS VARCHAR(20)) AS n, CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS q FROM lineitem"""
_PART = """CASE kind WHEN 0 THEN concat('## Line ', n, ' ##', chr(10), 'body ', q) WHEN 1 THEN concat('Line ', n, chr(10), '------', chr(10), 'body ', q) WHEN 2 THEN concat('````md', chr(10), '# not ', n, chr(10), '```', chr(10), 'no', chr(10), '---', chr(10), '````') ELSE concat('first', chr(10), 'second ', q, chr(10), '---') END"""


def _outlined(v: Inputs):
    whole = v.sql(f"SELECT doc_id, i, k, q, {_PART} AS part FROM ({_PARTS}) p").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "k", "q", "part"))).alias("l"))
    return whole.select("doc_id", F.concat(F.lit("# Invoice "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["part"]), "\n\n")).alias("text"))


_OUTLINE = f"""p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k, q) AS place FROM ({_PARTS})), g AS (SELECT *, 1 + sum(CASE WHEN kind < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM p),
  s AS (SELECT doc_id, section, max(CASE WHEN kind < 2 THEN concat('Line ', n) END) AS heading, string_agg(CASE WHEN kind < 2 THEN concat('body ', q)
      ELSE {_PART} END, concat(chr(10), chr(10)) ORDER BY place) AS body FROM g GROUP BY ALL)"""


def _pages(v: Inputs):
    """An HTML table of each order: two heading rows, a first cell that spans all lines, a cell of two columns in every third line."""
    line = F.concat(F.lit("<td>"), F.col("q"), F.lit("</td>"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("<td colspan='2'>p&amp;"), F.col("k").cast("string"), F.lit("</td>")))
        .otherwise(F.concat(F.lit("<TD>p&amp;"), F.col("k").cast("string"), F.lit("</TD><td>x<br>y</td>"))))
    rows = v.sql(_PARTS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "k", "q", line.alias("s")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("<tr>"),
                F.when(i == 0, F.concat(F.lit('<td rowspan="0">'), F.col("doc_id").cast("string"), F.lit("</td>"))).otherwise(""), x["s"],
                F.lit("</tr>"))), "")
    head = "<p>t</p><table class=a><thead><tr><th rowspan=2>order</th><th colspan=3>line</th></tr><tr><td>quantity</td><td>part</td><td>note</td></tr></thead><tbody>"
    return rows.select("doc_id", F.concat(F.lit(head), body, F.lit("</tbody></table>")).alias("html"))


_SPANNED_SQL = f"""
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k, q) AS r, CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END AS c
            FROM ({_PARTS})), w AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
            FROM p),
          h AS (SELECT * FROM (VALUES (1, 0, 0, 'order'), (1, 1, 0, 'order'), (2, 0, 1, 'line'), (2, 0, 2, 'line'), (2, 0, 3, 'line'), (3, 1, 1, 'quantity'),
              (4, 1, 2, 'part'), (5, 1, 3, 'note')) AS v(cell_id, row_no, col_no, text)),
          g AS (SELECT doc_id, cell_id, row_no, col_no, text, true AS is_heading FROM (SELECT DISTINCT doc_id FROM p) CROSS JOIN h UNION ALL
              SELECT doc_id, 6, r + 1, 0, CAST(doc_id AS VARCHAR), false FROM p
            UNION ALL SELECT doc_id, 7 + b, r + 1, 1, q, false FROM w UNION ALL SELECT doc_id, 8 + b, r + 1, 2, concat('p&', k), false FROM w UNION ALL
                SELECT doc_id, CASE WHEN c = 2 THEN 8 + b ELSE 9 + b END, r + 1, 3, CASE WHEN c = 2 THEN concat('p&', k) ELSE concat('x', chr(10), 'y') END,
                false FROM w)
        SELECT doc_id, 1 AS table_no, CAST(cell_id AS INT) AS cell_id, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, text, is_heading FROM g"""


def _sections(v: Inputs):
    return v.sql("SELECT doc_id, row_no AS section, 1 + row_no AS level, column_name AS heading, concat(' ', value, ' ') AS body FROM ref_cells WHERE column_name = 'quantity'")


def _required(v: Inputs):
    return v.spark.createDataFrame(_REQUIRED, "document_type string, field string")


def _merged(v: Inputs):
    return a.merge_candidates(v("candidates"))


def _ready(v: Inputs):
    return a.readiness(v.sql(_TYPES), v("pred_fields").withColumn("is_valid", F.col("doc_id") % 4 != 0), _required(v))


def _refined(v: Inputs):
    def extract(docs, iteration):  # only the orders that are asked for, before they become several candidates each
        asked = v("orders").join(docs.select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi")
        return Inputs(v.spark, v.sf_dir, {"orders": asked})("candidates").where(F.col("seq") <= iteration)

    return a.iterative_refine(v.sql(_TYPES), extract, _required(v), 3, 0.5)[1].select("doc_id", "iteration", "stop_reason")


def _ranked(v: str = "candidates") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY CASE WHEN is_valid THEN 1 ELSE 0 END DESC, confidence DESC, extracted_at DESC, seq DESC) AS r FROM {v}"""


_MD = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM md_docs),
  p AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row_no FROM l WHERE contains(line, '|') AND NOT regexp_matches(line, '^[ |:-]+$')),
  c AS (SELECT doc_id, row_no, trim(split_part(line, '|', 2)) AS a, trim(split_part(line, '|', 3)) AS b FROM p),
  cells AS (SELECT doc_id, 1 AS table_no, row_no, 0 AS col_no, a AS text, true AS is_heading FROM c UNION ALL SELECT doc_id, 1, row_no, 1, b, row_no = 0 FROM c)"""

PLANS = {
    "t01_check_payload": (lambda v: t.check_payload(v.sql(_PAYLOADS)), f"""
        WITH p AS (SELECT doc_id, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS j
            FROM ({_PAYLOADS})), t AS (SELECT *, json_type(j, '$.fields') AS f, json_type(j, '$.rows') AS r, json_type(j, '$.warnings') AS w FROM p),
          k AS (SELECT doc_id, unnest(json_keys(j, '$.fields')) AS name, j FROM t WHERE f = 'OBJECT'), m AS (SELECT doc_id, name, json_extract(j,
              concat('$.fields.', name)) AS v FROM k), n AS (SELECT *, json_type(v, '$.confidence') AS ct, TRY_CAST(v ->> '$.confidence' AS DOUBLE) AS c
              FROM m),
          a AS (SELECT doc_id, unnest(range(0, CAST(json_array_length(j, '$.rows') AS BIGINT))) AS i, j FROM t WHERE r = 'ARRAY')
        SELECT doc_id, '$' AS path, 'not-json' AS issue FROM t WHERE j IS NULL UNION ALL SELECT doc_id, '$.fields', 'not-object' FROM t
            WHERE j IS NOT NULL AND f <> 'OBJECT' UNION ALL SELECT doc_id, '$.rows', 'not-array' FROM t WHERE r <> 'ARRAY'
        UNION ALL SELECT doc_id, '$.warnings', 'not-strings' FROM t WHERE w = 'ARRAY' AND json_type(j, '$.warnings[0]') <> 'VARCHAR' UNION ALL
            SELECT doc_id, '$.summary', 'not-text' FROM t WHERE json_type(j, '$.summary') <> 'VARCHAR' UNION ALL SELECT doc_id, '$.documentType', 'not-text'
            FROM t WHERE json_type(j, '$.documentType') <> 'VARCHAR'
        UNION ALL SELECT doc_id, concat('$.rows[', i, ']'), 'not-object' FROM a WHERE json_type(j, concat('$.rows[', i, ']')) <> 'OBJECT'
        UNION ALL SELECT doc_id, concat('$.fields.', name), CASE WHEN json_type(v) <> 'OBJECT' OR NOT json_exists(v, '$.value') THEN 'no-value'
            ELSE 'bad-confidence' END FROM n WHERE json_type(v) <> 'OBJECT' OR NOT json_exists(v, '$.value') OR ct IS NULL OR c IS NULL OR c < -0.05
            OR c > 1.05"""),
    "t02_normalize_fields": (lambda v: _amounts(v).select("doc_id", "value", F.round("confidence", 6).alias("confidence"), "warning"), f"""
        WITH amounts AS ({_AMOUNTS}), x AS (SELECT *, CASE WHEN currency = 'KWD' THEN '0' ELSE '' END AS z, currency IS NOT NULL AND currency = 'KWD' AS three
            FROM ({_PRINTED}) q)
        SELECT doc_id, CASE style WHEN 0 THEN concat(w, d, '.', f, z) WHEN 1 THEN concat('-', w, '.00', z) WHEN 2 THEN concat(w, d, '.', f, z)
            WHEN 3 THEN concat(w, '.00', z) WHEN 5 THEN CASE WHEN three THEN concat(w, '.', d) ELSE concat(w, d, '.00') END WHEN 7 THEN concat('-', w, '.', f,
            z) WHEN 8 THEN concat(w, d, '.', f, z) WHEN 9 THEN concat(w, d, '.', f, z)
            WHEN 10 THEN concat('-', w, '.', f, z) WHEN 11 THEN concat(w, '.', f, z) WHEN 12 THEN concat('-', w, '.', f, z) WHEN 13 THEN concat(w, d, d, '.00',
                z) WHEN 15 THEN concat('0.', f, z) WHEN 16 THEN concat(w, '.', f, z) WHEN 18 THEN concat(w, '.00', z) ELSE value END AS value,
          round(greatest(0.0, least(1.0::DOUBLE, confidence)), 6) AS confidence,
          CASE WHEN style = 4 THEN 'separator-after-letters' WHEN style = 5 THEN 'ambiguous-separator' WHEN style IN (6, 14) THEN 'unreadable-amount'
              WHEN confidence < 0 OR confidence > 1 THEN 'clamped-confidence' END AS warning FROM x"""),
    "t03_document_currency": (lambda v: t.document_currency(v.sql("SELECT o_orderkey AS doc_id, 'currency' AS field, CASE o_orderkey % 3 WHEN 0 THEN 'KWD' ELSE 'EUR' END AS value FROM orders UNION ALL SELECT doc_id, field, value FROM ref_fields")), "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'KWD' ELSE 'EUR' END AS currency FROM orders"),
    "t04_validate_rules": (lambda v: t.validate_rules(_docs(v), v.sql(_TAGGED).withColumn("items", F.when(F.col("field") == "tags", F.split("value", ","))), _broken_rules(v)), f"""
        WITH r AS (SELECT * FROM (VALUES ('invoice_number', true, '^INV-[0-9]+$'), ('invoice_date', true, NULL), ('customer_name', true, '*'), ('total', true,
            '^[0-9.]+$'), ('tags', false, '^[a-z]+$')) AS v(field, required, pattern)), j AS (SELECT o_orderkey AS doc_id, r.*, value
            FROM orders CROSS JOIN r LEFT JOIN ({_TAGGED}) p ON p.doc_id = o_orderkey AND p.field = r.field),
          e AS (SELECT *, unnest(CASE WHEN field = 'tags' THEN string_split(value, ',') ELSE [value] END) AS entry FROM j WHERE trim(value) <> '')
        SELECT doc_id, field, 'required' AS issue, NULL AS entry FROM j WHERE required AND coalesce(trim(value), '') = '' UNION ALL
            SELECT doc_id, field, 'invalid-pattern', NULL FROM j WHERE pattern = '*' AND trim(value) <> ''
        UNION ALL SELECT doc_id, field, 'pattern', entry FROM e WHERE pattern <> '*' AND NOT regexp_matches(entry, CASE WHEN pattern = '*' THEN '' ELSE pattern END)"""),
    "t05_check_types": (lambda v: t.check_types(v.sql(_TYPED), _typed_rules(v)), f"""
        WITH x AS ({_TYPED}), y AS (SELECT *, CASE field WHEN 'when' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
            OR TRY_CAST(left(value, 10) AS DATE) IS NULL THEN 'not-iso-date' END WHEN 'mail' THEN CASE WHEN NOT regexp_matches(value,
            '^(mailto:)?[^@ ]+@[^@ ]+[.][^@ ]+$') THEN 'odd-email' END
            ELSE CASE WHEN NOT regexp_matches(value, '^(https?://)?[^/@: ]+[.][^/@: ]+(:[0-9]+)?(/.*)?$') THEN 'unsafe-url' END END AS warning FROM x)
        SELECT doc_id, field, CASE field WHEN 'when' THEN 'date' WHEN 'mail' THEN 'email' ELSE 'url' END AS type, CASE WHEN warning = 'unsafe-url' THEN NULL
            ELSE value END AS value, warning FROM y"""),
    "t06_unknown_fields": (lambda v: t.unknown_fields(v("pred_fields"), _rules(v)), "SELECT doc_id, array_to_string(list_sort(list_distinct(list(field))), ',') AS fields FROM pred_fields WHERE field NOT IN ('invoice_number', 'invoice_date', 'customer_name', 'total') GROUP BY doc_id"),
    "t07_cap_rows": (lambda v: t.cap_rows(v("pred_cells"), 3, 4), """
        WITH f AS (SELECT doc_id, row_no, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n
            FROM (SELECT doc_id, row_no FROM pred_cells GROUP BY doc_id, row_no HAVING bool_or(trim(value) <> '')))
        SELECT c.doc_id, c.row_no, column_name, left(value, 4) AS value, greatest(n - 3, 0) AS dropped_rows
            FROM pred_cells c JOIN f ON c.doc_id = f.doc_id AND c.row_no = f.row_no WHERE r <= 3"""),
    "t08_extra_columns": (lambda v: t.extra_columns(v("pred_cells"), _columns(v)), "SELECT doc_id, column_name, min(row_no) AS first_row FROM pred_cells WHERE column_name NOT IN ('quantity', 'line_total') GROUP BY doc_id, column_name"),
    "t09_empty_tables": (lambda v: t.empty_tables(_docs(v), v("pred_cells")), "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM pred_cells WHERE trim(value) <> '')"),
    "t10_duplicate_rules": (lambda v: t.duplicate_rules(v.sql("SELECT o_custkey AS preset_id, o_orderkey AS pos, o_orderpriority AS field FROM orders")), "SELECT o_custkey AS preset_id, o_orderpriority AS field, o_orderkey AS pos FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1"),
    "t11_to_records": (lambda v: t.to_records(v("pred_fields"), ["invoice_number", "invoice_date", "customer_name", "total"]), """
        SELECT doc_id, max(value) FILTER (field = 'invoice_number') AS invoice_number, max(value) FILTER (field = 'invoice_date') AS invoice_date,
            max(value) FILTER (field = 'customer_name') AS customer_name, max(value) FILTER (field = 'total') AS total FROM pred_fields GROUP BY doc_id"""),
    "t12_render_markdown": (_rendered, f"""
        WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 > 0 THEN concat('Order of ', o_custkey) ELSE '' END AS summary
            FROM orders), q AS (SELECT * FROM (VALUES (1, 'invoice_number'), (2, 'invoice_date'), (3, 'customer_name'), (4, 'total')) AS v(pos, field)),
          f AS (SELECT d.doc_id, string_agg(concat('| ', q.field, ' | ', coalesce(value, 'Not found'), ' | ', CAST(round(coalesce(confidence,
              0) * 100) AS INT), '% |'), chr(10) ORDER BY pos) AS t FROM d CROSS JOIN q LEFT JOIN pred_fields p ON p.doc_id = d.doc_id AND p.field = q.field
              GROUP BY d.doc_id),
          c AS (SELECT doc_id, row_no, concat('| ', max(value) FILTER (column_name = 'quantity'), ' | ', max(value) FILTER (column_name = 'line_total'),
              ' |') AS s FROM ref_cells WHERE doc_id % 3 > 0 GROUP BY ALL), r AS (SELECT doc_id, concat(chr(10), chr(10), '## Rows', chr(10), chr(10),
              '| quantity | line_total |', chr(10), '| --- | --- |', chr(10), string_agg(s, chr(10) ORDER BY row_no)) AS t FROM c GROUP BY doc_id),
          n AS (SELECT doc_id, kind, string_agg(s, chr(10) ORDER BY s) AS t FROM (SELECT doc_id, kind, concat('- ',
              replace(replace(replace(replace(replace(message, chr(10), ' '), '|', chr(92) || '|'), '`', chr(92) || '`'), '<', '&lt;'), '>', '&gt;')) AS s
              FROM ({_NOTES})) GROUP BY ALL)
        SELECT d.doc_id, concat('# Invoice Extraction', chr(10), chr(10), summary, chr(10), chr(10), '## Fields', chr(10), chr(10),
            '| Field | Value | Confidence |', chr(10), '| --- | --- | --- |', chr(10), f.t, coalesce(r.t, ''),
          CASE WHEN e.t IS NULL THEN '' ELSE concat(chr(10), chr(10), '## Validation', chr(10), chr(10), e.t) END, CASE WHEN v.t IS NULL THEN ''
              ELSE concat(chr(10), chr(10), '## Validation warnings', chr(10), chr(10), v.t) END, CASE WHEN w.t IS NULL THEN '' ELSE concat(chr(10), chr(10),
              '## Warnings', chr(10), chr(10), w.t) END) AS markdown
        FROM d JOIN f ON f.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, concat('', t) AS t FROM n
            WHERE kind = 'error') e ON e.doc_id = d.doc_id LEFT JOIN (SELECT * FROM n WHERE kind = 'validation') v ON v.doc_id = d.doc_id LEFT JOIN (SELECT *
            FROM n WHERE kind = 'warning') w ON w.doc_id = d.doc_id"""),
    "t13_export_csv": (lambda v: t.export_csv(v.sql("SELECT doc_id, row_no, column_name, CASE doc_id % 4 WHEN 0 THEN concat('=', value) WHEN 1 THEN concat('-', value) WHEN 2 THEN concat('+a', value) ELSE value END AS value FROM ref_cells"), ["quantity", "line_total"]), """
        WITH x AS (SELECT doc_id, row_no, column_name, CASE doc_id % 4 WHEN 0 THEN concat('''=', value) WHEN 1 THEN concat('-', value)
            WHEN 2 THEN concat('''+a', value) ELSE value END AS value FROM ref_cells)
        SELECT doc_id, row_no, max(value) FILTER (column_name = 'quantity') AS quantity, max(value) FILTER (column_name = 'line_total') AS line_total FROM x
            GROUP BY doc_id, row_no"""),
    "t14_validate_nested_arrays": (lambda v: t.validate_outputs(v("order_json"), _order_schema(v), n=5), """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line) - 1 AS i
            FROM (SELECT *, concat(',{', CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('"price": ', CASE WHEN l_partkey % 7 = 0 THEN '-' ELSE '' END,
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)), ', ') END,
                CASE WHEN l_linenumber = 6 THEN '"extra": null, ' ELSE '' END, '"qty": ', CASE WHEN l_suppkey % 11 = 0 THEN '"many"'
                    ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END, ', "tags": ["a"', CASE WHEN l_partkey % 13 = 0 THEN ', 5' ELSE '' END, ', "',
                    l_returnflag, '"]}') AS line FROM lineitem)),
          b AS (SELECT l_orderkey AS doc_id, CAST([] AS BIGINT[]) AS place, 2 AS pos, 'items' AS property, 'max-items' AS issue FROM lineitem
              GROUP BY l_orderkey HAVING count(*) > 6
            UNION ALL SELECT DISTINCT l_orderkey, CAST([] AS BIGINT[]), 1048576, 'odd', 'unexpected' FROM lineitem WHERE l_orderkey % 9 = 0
            UNION ALL SELECT l_orderkey, [i], 3, concat('items[', i, '].price'), CASE WHEN l_partkey % 5 = 0 THEN 'missing' ELSE 'minimum' END FROM l
                WHERE l_partkey % 5 = 0 OR l_partkey % 7 = 0 AND l_extendedprice >= 0.01
            UNION ALL SELECT l_orderkey, [i], 4, concat('items[', i, '].qty'), 'type' FROM l WHERE l_suppkey % 11 = 0
            UNION ALL SELECT l_orderkey, [i, 1], 5, concat('items[', i, '].tags[1]'), 'type' FROM l WHERE l_partkey % 13 = 0
            UNION ALL SELECT l_orderkey, [i], 1048576, concat('items[', i, '].extra'), 'unexpected' FROM l WHERE l_linenumber = 6),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, place, property, issue) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM b)
        SELECT doc_id, CAST(n AS INT) AS n, property, issue, CAST(greatest(total - 5, 0) AS BIGINT) AS more FROM r WHERE n <= 5"""),
    "t14_validate_outputs": (lambda v: t.validate_outputs(v.sql(_OUTPUTS), _schema(v), n=2), f"""
        WITH p AS (SELECT doc_id, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS j
            FROM ({_OUTPUTS})), x AS (SELECT *, json_type(j, '$.total') AS tt, json_type(j, '$.kind') AS kt, json_type(j, '$.party') AS pt, json_type(j,
            '$.items') AS it FROM p),
          i AS (SELECT doc_id, 0 AS pos, '' AS property, 'not-json' AS issue FROM x WHERE j IS NULL UNION ALL
              SELECT doc_id, 1, 'total', CASE WHEN tt IS NULL THEN 'missing' WHEN tt = 'VARCHAR' THEN 'type'
              WHEN CAST(j ->> '$.total' AS DOUBLE) < 0 THEN 'minimum' WHEN CAST(j ->> '$.total' AS DOUBLE) > 10 THEN 'maximum' END FROM x WHERE j IS NOT NULL
            UNION ALL SELECT doc_id, 2, 'kind', CASE WHEN kt <> 'VARCHAR' THEN 'type' WHEN (j ->> '$.kind') NOT IN ('a', 'b') THEN 'enum' END FROM x UNION ALL
                SELECT doc_id, 3, 'party', CASE WHEN pt IS NULL THEN 'missing' WHEN pt <> 'OBJECT' THEN 'type' END FROM x WHERE j IS NOT NULL
            UNION ALL SELECT doc_id, 4, 'party.name', 'missing' FROM x WHERE pt = 'OBJECT' AND NOT json_exists(j, '$.party.name') UNION ALL
                SELECT doc_id, 5, 'items', CASE WHEN json_array_length(j, '$.items') < 1 THEN 'min-items' WHEN json_array_length(j,
                '$.items') > 3 THEN 'max-items' END FROM x WHERE it = 'ARRAY'
            UNION ALL SELECT doc_id, 1048576, k, 'unexpected' FROM (SELECT doc_id, unnest(json_keys(j)) AS k FROM x)
                WHERE k NOT IN ('total', 'kind', 'party', 'items', 'o') UNION ALL SELECT doc_id, 1048576, 'party.odd', 'unexpected' FROM x
                WHERE pt = 'OBJECT' AND json_exists(j, '$.party.odd')),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, property) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM i WHERE issue IS NOT NULL)
        SELECT doc_id, CAST(n AS INT) AS n, property, issue, greatest(c - 2, 0) AS more FROM r WHERE n <= 2"""),
    "m01_markdown_sections": (lambda v: m.markdown_sections(_outlined(v)).select("doc_id", "section", "level", "heading", "is_title", F.array_join("lines", "\n").alias("body")), f"""
        WITH {_OUTLINE} SELECT doc_id, CAST(section AS BIGINT) AS section, CASE WHEN section = 1 THEN 1 ELSE 2 END AS level, CASE
            WHEN section = 1 THEN concat('Invoice ', doc_id) ELSE heading END AS heading, section = 1 AS is_title, body FROM s
        UNION ALL SELECT doc_id, 1, 1, concat('Invoice ', doc_id), true, '' FROM (SELECT DISTINCT doc_id FROM s) WHERE doc_id NOT IN (SELECT doc_id FROM s
            WHERE section = 1)"""),
    "m02_sections_to_markdown": (lambda v: m.sections_to_markdown(_sections(v)), """
        SELECT doc_id, string_agg(concat(repeat('#', CAST(least(6, 1 + row_no) AS INT)), ' ', column_name, chr(10), chr(10), value), concat(chr(10),
            chr(10)) ORDER BY row_no, concat(repeat('#', CAST(least(6, 1 + row_no) AS INT)), value)) AS text FROM ref_cells WHERE column_name = 'quantity'
            GROUP BY doc_id"""),
    "m03_table_cells": (lambda v: m.table_cells(v("md_docs")), f"WITH {_MD} SELECT doc_id, table_no, row_no, col_no, text, is_heading FROM cells"),
    "m04_html_table_cells": (lambda v: m.html_table_cells(_pages(v)), _SPANNED_SQL),
    "m05_cell_neighbors": (lambda v: m.cell_neighbors(m.markdown_tables(v("md_docs"))).select("doc_id", "table_no", "row_no", "col_no", "text", *[F.array_join(c, "|").alias(c) for c in ("up", "down", "left", "right")]), f"""WITH {_MD} SELECT doc_id, table_no, row_no, col_no, text, coalesce(lag(text) OVER c2, '') AS up, coalesce(lead(text) OVER c2, '') AS down, coalesce(lag(text) OVER r2, '') AS "left", coalesce(lead(text) OVER r2, '') AS "right" FROM cells
        WINDOW c2 AS (PARTITION BY doc_id, col_no ORDER BY row_no), r2 AS (PARTITION BY doc_id, row_no ORDER BY col_no)"""),
    "m05_spanned_neighbors": (lambda v: m.cell_neighbors(_pages(v)).select("doc_id", F.col("cell_id").cast("int").alias("cell_id"), *[F.array_join(c, "|").alias(c) for c in ("up", "down", "left", "right")]), f"""
        WITH cells AS ({_SPANNED_SQL}), f AS (SELECT doc_id, cell_id, min(row_no) AS y, min(col_no) AS x, any_value(text) AS text FROM cells GROUP BY ALL),
          n AS (SELECT DISTINCT a.doc_id, a.cell_id, CASE WHEN b.row_no < a.row_no THEN 'up' WHEN b.row_no > a.row_no THEN 'down'
              WHEN b.col_no < a.col_no THEN 'left' ELSE 'right' END AS side, b.cell_id AS other
              FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.cell_id <> b.cell_id AND abs(a.row_no - b.row_no) + abs(a.col_no - b.col_no) = 1),
          t AS (SELECT n.doc_id, n.cell_id, side, string_agg(f.text, '|' ORDER BY f.y, f.x) AS t FROM n JOIN f ON f.doc_id = n.doc_id AND f.cell_id = n.other
              GROUP BY ALL)
        SELECT f.doc_id, f.cell_id, coalesce(max(t.t) FILTER (side = 'up'), '') AS up, coalesce(max(t.t) FILTER (side = 'down'), '') AS down,
            coalesce(max(t.t) FILTER (side = 'left'), '') AS "left", coalesce(max(t.t) FILTER (side = 'right'), '') AS "right"
            FROM f LEFT JOIN t ON t.doc_id = f.doc_id AND t.cell_id = f.cell_id GROUP BY ALL"""),
    "m06_cell_headings": (lambda v: m.cell_headings(m.markdown_tables(v("md_docs"))).select("doc_id", "table_no", "row_no", "col_no", "text", *[F.array_join(c, "|").alias(c) for c in ("top_heading", "left_heading")]), f"""WITH {_MD} SELECT doc_id, table_no, row_no, col_no, text,
          coalesce((SELECT array_to_string(list_sort(list_distinct(list(x.text))), '|') FROM cells x
              WHERE x.doc_id = k.doc_id AND x.col_no = k.col_no AND x.row_no < k.row_no AND x.is_heading), (SELECT arg_min(x.text, x.row_no) FROM cells x
              WHERE x.doc_id = k.doc_id AND x.col_no = k.col_no AND x.row_no < k.row_no), '') AS top_heading,
          coalesce((SELECT array_to_string(list_sort(list_distinct(list(x.text))), '|') FROM cells x
              WHERE x.doc_id = k.doc_id AND x.row_no = k.row_no AND x.col_no < k.col_no AND x.is_heading), (SELECT arg_min(x.text, x.col_no) FROM cells x
              WHERE x.doc_id = k.doc_id AND x.row_no = k.row_no AND x.col_no < k.col_no), '') AS left_heading FROM cells k"""),
    "m06_spanned_headings": (lambda v: m.cell_headings(_pages(v)).where("row_no > 1 and col_no > 0").select("doc_id", F.col("cell_id").cast("int").alias("cell_id"), *[F.array_join(c, "|").alias(c) for c in ("top_heading", "left_heading")]), f"""
        WITH cells AS ({_SPANNED_SQL}), f AS (SELECT doc_id, cell_id, min(col_no) AS x, bool_or(EXISTS (SELECT 1 FROM cells w
            WHERE w.doc_id = c.doc_id AND w.row_no <= c.row_no AND w.row_no > 1 AND w.col_no = 2 AND EXISTS (SELECT 1 FROM cells z
            WHERE z.doc_id = w.doc_id AND z.cell_id = w.cell_id AND z.col_no = 3))) AS wide FROM cells c WHERE row_no > 1 AND col_no > 0 GROUP BY ALL)
        SELECT doc_id, cell_id, CASE WHEN x = 1 THEN 'line|quantity' WHEN wide THEN 'line|note|part' WHEN x = 2 THEN 'line|part'
            ELSE 'line|note' END AS top_heading, CAST(doc_id AS VARCHAR) AS left_heading FROM f"""),
    "a01_canonicalize": (lambda v: a.canonicalize(v.sql(_NAMED), *a.alias_tables(v.spark)), f"""
        WITH n AS ({_NAMED}), k AS (SELECT *, trim(regexp_replace(replace(lower(trim(document_type)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS clean
            FROM n), c AS (SELECT doc_id, value, CASE WHEN clean IN ('bill', 'invoices') THEN 'invoice' WHEN clean = 'receipts' THEN 'receipt'
            WHEN clean IN ('cv', 'curriculum vitae') THEN 'resume' WHEN clean = '' THEN 'unknown' ELSE clean END AS document_type,
            trim(regexp_replace(lower(field), '[^a-z0-9]+', '_', 'g'), '_') AS field FROM k)
        SELECT doc_id, document_type, CASE WHEN field = 'grand_total' AND document_type IN ('invoice', 'receipt') THEN 'total_amount' WHEN field = 'bill_to'
            AND document_type = 'invoice' THEN 'customer_name' ELSE field END AS field, value FROM c"""),
    "a02_merge_candidates": (lambda v: _merged(v).drop("page"), f"SELECT doc_id, field, value, confidence, is_valid, extracted_at, seq FROM ({_ranked()}) WHERE r = 1"),
    "a02_merge_locations": (lambda v: _merged(v).select("doc_id", "field", "page"), """
        WITH RECURSIVE c AS (SELECT *, struct_pack(v := coalesce(is_valid, true), c := coalesce(confidence, 0), t := extracted_at, s := seq) AS rank FROM candidates),
          f AS (SELECT doc_id, field, seq, rank, page FROM c WHERE seq = 1 UNION ALL SELECT c.doc_id, c.field, c.seq, greatest(c.rank, f.rank), CASE
              WHEN c.rank >= f.rank THEN coalesce(c.page, f.page) ELSE coalesce(f.page, c.page) END
              FROM f JOIN c ON c.doc_id = f.doc_id AND c.field = f.field AND c.seq = f.seq + 1)
        SELECT doc_id, field, page FROM f WHERE seq = 3"""),
    "a03_validate_candidates": (lambda v: a.validate_candidates(v.sql(_RULED)).select("doc_id", "field", "value", "rule", "valid", "message"), f"""
        WITH x AS (SELECT doc_id, field, value, coalesce(nullif(trim(rule), ''), CASE WHEN contains(field, 'email') THEN 'email' WHEN contains(field,
            'phone') THEN 'phone' WHEN contains(field, 'date') THEN 'date' WHEN field = 'total' THEN 'currency' END) AS rule FROM ({_RULED})),
          y AS (SELECT *, CASE rule WHEN 'email' THEN regexp_full_match(value, '[^@ ]+@[^@ ]+[.][^@ ]+') WHEN 'phone' THEN regexp_full_match(value,
              '[+]?[0-9 ()-]+') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 10 WHEN 'date' THEN regexp_full_match(value,
              '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(value AS DATE) IS NOT NULL
              WHEN 'currency' THEN regexp_matches(value, '[0-9]') WHEN 'number' THEN regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '[0-9]-')
                  ELSE true END AS valid FROM x)
        SELECT *, CASE WHEN coalesce(rule, 'free') NOT IN ('email', 'phone', 'date', 'currency', 'number') THEN 'No validation rule applied' 
            WHEN rule = 'phone' THEN CASE WHEN regexp_full_match(value, '[+]?[0-9 ()-]+') THEN 'Valid phone format' ELSE 'Invalid phone format' END
            ELSE concat(CASE WHEN valid THEN 'Valid ' ELSE 'Invalid ' END, CASE WHEN rule = 'date' AND valid THEN 'date' WHEN rule = 'date' THEN 'date or time'
                ELSE concat(rule, ' format') END) END AS message FROM y"""),
    "a04_check_subtotals": (lambda v: a.check_subtotals(v.sql(_ITEMS)).select("doc_id", F.col("subtotal").cast("double").alias("subtotal"), F.col("items_sum").cast("double").alias("items_sum"), "ok"), """
        SELECT l_orderkey AS doc_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS subtotal,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS items_sum,
          NOT (l_orderkey % 5 = 0 AND l_orderkey % 7 <> 0 AND count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1
              AND max(l_linenumber) = count(*)) AS ok FROM lineitem GROUP BY l_orderkey"""),
    "a05_check_date_order": (lambda v: a.check_date_order(v.sql(_DATES)), "SELECT o_orderkey AS doc_id, 'due_date' AS field, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) <= DATE '1990-01-01' WHEN 1 THEN true ELSE CAST(o_orderdate AS DATE) <= DATE '1994-06-05' END AS ok FROM orders"),
    "a06_apply_reviews": (lambda v: a.apply_reviews(v("pred_fields").select("doc_id", "field", "value"), v.sql("SELECT doc_id, field, value, CASE WHEN doc_id % 2 = 0 THEN 'format' ELSE 'consistency' END AS check, doc_id % 3 = 0 AS ok FROM ref_fields UNION ALL SELECT doc_id, field, value, 'cross-reference', doc_id % 5 = 0 FROM ref_fields")), """
        WITH r AS (SELECT doc_id, field, value, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'format' ELSE 'consistency' END
            WHEN doc_id % 5 <> 0 THEN 'cross-reference' END AS c FROM ref_fields)
        SELECT p.doc_id, p.field, p.value, r.c IS NULL AS is_valid, r.c AS failed_check FROM pred_fields p LEFT JOIN r ON p.doc_id = r.doc_id
            AND p.field = r.field AND p.value = r.value"""),
    "a07_readiness": (lambda v: _ready(v).withColumn("confidence", F.round("confidence", 9)), None),
    "a08_completion": (lambda v: a.completion(_ready(v), 0.5), None),
    "a09_iterative_refine": (_refined, None),
    "a10_stop_reasons": (lambda v: a.stop_reasons(v.sql(_PASSES)), "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'no-progress' ELSE 'confidence-and-coverage-met' END AS reason, count(*) AS documents, avg(1 + o_orderkey % 3) AS mean_iterations FROM orders GROUP BY 1"),
    "a11_check_regions": (lambda v: a.check_regions(v.sql(_REGIONS)).select("doc_id", "region_ok"), f"SELECT doc_id, units = 'normalized' AND page >= 1 AND x >= 0 AND x < 1 AND y >= 0 AND y < 1 AND height > 0 AND x + width <= 1 AND y + height <= 1 AS region_ok FROM ({_REGIONS})"),
    "a12_layout_profile": (lambda v: a.layout_profile(v.sql(_LAYOUT)), f"SELECT doc_id, count(*) AS features, array_to_string(list_sort(list_distinct(list(feature))), ',') AS distinct_features, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS complexity FROM ({_LAYOUT}) GROUP BY doc_id"),
    "a13_coalesce_trace": (lambda v: a.coalesce_trace(v("steps")), """
        WITH x AS (SELECT *, CASE WHEN coalesce(lag(type) OVER w = type AND lag(source) OVER w = source AND lag(is_delta) OVER w AND is_delta AND NOT has_call
            AND NOT lag(has_call) OVER w AND (lag(id) OVER w IS NOT DISTINCT FROM id), false) THEN 0 ELSE 1 END AS n
            FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
          y AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step FROM x)
        SELECT doc_id, CAST(step AS BIGINT) AS step, min(type) AS type, min(source) AS source, CAST(count(*) AS INT) AS parts, string_agg(content,
            '' ORDER BY seq) AS content FROM y GROUP BY doc_id, step"""),
}

_READY = f"""d AS ({_TYPES}), f AS (SELECT doc_id, field, confidence, doc_id % 4 <> 0 AS ok FROM pred_fields WHERE trim(value) <> ''), q AS (SELECT unnest(['invoice_number', 'invoice_date', 'customer_name', 'total']) AS field),
  s AS (SELECT doc_id, count(*) AS populated, count(*) FILTER (ok) AS valid, avg(confidence) AS confidence FROM f GROUP BY doc_id),
  g AS (SELECT d.doc_id, count(f.field) AS got, coalesce(string_agg(q.field, ',' ORDER BY q.field) FILTER (f.field IS NULL), '') AS missing
      FROM d CROSS JOIN q LEFT JOIN f ON f.doc_id = d.doc_id AND f.field = q.field AND f.ok WHERE d.document_type = 'invoice' GROUP BY d.doc_id),
  ready AS (SELECT d.doc_id, document_type, coalesce(populated, 0) AS populated, coalesce(valid, 0) AS valid, coalesce(confidence, 0) AS confidence,
      coalesce(missing, '') AS missing,
    CASE WHEN document_type = 'form' THEN 1.0 WHEN document_type = 'invoice' THEN got / 4.0 WHEN coalesce(populated, 0) > 0 THEN 1.0
        ELSE 0.0 END::DOUBLE AS coverage FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN g ON d.doc_id = g.doc_id)"""
_LATER = {"a07_readiness": f"WITH {_READY} SELECT doc_id, document_type, populated, valid, round(confidence, 9) AS confidence, missing, coverage FROM ready",
    "a08_completion": f"WITH {_READY}, x AS (SELECT doc_id, CASE WHEN valid = 0 THEN 'no-fields' WHEN missing <> '' THEN 'missing-required-fields' WHEN confidence < 0.5 THEN 'below-confidence-threshold' ELSE 'confidence-and-coverage-met' END AS reason FROM ready) SELECT doc_id, reason, reason = 'confidence-and-coverage-met' AS complete FROM x",}
PLANS |= {k: (PLANS[k][0], sql) for k, sql in _LATER.items()}
