"""Queries of scoring and evaluation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import scoring as e
from quire.operators import structure as m
from quire.views import Inputs

_OUT = "SELECT doc_id, reference AS text FROM text_pairs"
# printed values of fields, right and damaged, by document and field
_VALUES = "SELECT concat(CAST(r.doc_id AS VARCHAR(20)), '/', r.field) AS doc_id, r.value AS reference, p.value AS prediction FROM ref_fields r LEFT JOIN pred_fields p ON r.doc_id = p.doc_id AND r.field = p.field"
_EDITS = f"""v AS ({_VALUES}), e AS (SELECT doc_id, length(reference) AS n, coalesce(length(prediction), 0) AS m, levenshtein(reference, coalesce(prediction, '')) AS d, levenshtein(lower(reference), lower(coalesce(prediction, ''))) AS nd FROM v)"""


def _unit(c: str) -> str:
    """Unit-test text of ``c`` in DuckDB's SQL, for texts whose only marks are stars and that are composed already."""
    for mark in (r"\*\*", r"\*\*", r"\*"):
        c = f"regexp_replace({c}, '{mark}(.*?){mark}', '\\1', 'g')"
    return f"regexp_replace({c}, '\\s+', ' ', 'g')"


def _bytes(c: str) -> str:
    """``c`` with one byte for each character: DuckDB's distance counts bytes."""
    return f"regexp_replace({c}, '[^ -~]', '?', 'g')"


def _near(needle: str, hay: str) -> str:
    """Whether a stretch of ``hay`` that starts at place i is within k edits of an ASCII ``needle``."""
    return f"len(list_filter(range(greatest(length({needle}) - k, 0), length({needle}) + k + 1), lambda l: levenshtein(substr({hay}, i, l), {needle}) <= k)) > 0"


_METRICS = "SELECT case_id, 'cer' AS metric, metric AS score FROM case_results UNION ALL SELECT case_id, route, metric / 2 FROM case_results"
_CASES = """SELECT o_orderkey AS case_id, CASE o_orderkey % 9 WHEN 0 THEN 'other' WHEN 1 THEN 'template' WHEN 2 THEN 'agentic' WHEN 3 THEN NULL ELSE 'simple' END AS mode, CASE o_orderkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN ' ' END AS preset_id, CAST(o_orderkey % 4 AS INT) AS assertions,
    CAST(o_orderkey % 13 AS DOUBLE) / 10 AS threshold, o_custkey % 5 AS max_iterations, CASE o_custkey % 7 WHEN 0 THEN 'canary' WHEN 1 THEN 'smoke'
        WHEN 2 THEN NULL ELSE 'full' END AS suite, CASE o_custkey % 11 WHEN 0 THEN 'wer' WHEN 1 THEN 'bleu' WHEN 2 THEN NULL ELSE 'field_f1' END AS metric
        FROM orders
    UNION ALL SELECT o_orderkey, 'simple', NULL, 1, 0.5, 1, 'full', 'cer' FROM orders WHERE o_orderkey % 50 = 0"""
_UNIT = "SELECT event_id AS test_id, user_id AS doc_id, CASE event_type WHEN 'click' THEN 'present' WHEN 'view' THEN 'absent' WHEN 'error' THEN 'math' ELSE 'order' END AS type, event_id % 3 <> 0 AS checked, CAST(1 + event_id % 2 AS INT) AS page, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS category FROM events"


def _docs(v: Inputs):
    return v.sql("SELECT o_orderkey AS doc_id FROM orders")


# every order is a case with an assertion of one kind, one in two with a second
_CHECKS = """SELECT o_orderkey AS case_id, k AS kind, CASE k WHEN 0 THEN 'contains' WHEN 1 THEN 'not_contains' WHEN 2 THEN 'json_field_equals' WHEN 3 THEN 'json_field_exists' WHEN 4 THEN 'json_field_number_min' WHEN 5 THEN 'metric_min' WHEN 6 THEN 'metric_max' ELSE 'table_min_rows' END AS type,
    CASE k WHEN 4 THEN 2.0 WHEN 7 THEN 3.0 ELSE 0.3 END AS min FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders UNION ALL
        SELECT o_orderkey, (o_orderkey + o_custkey) % 8 FROM orders WHERE o_custkey % 2 = 0) c"""
_OUTPUTS = """SELECT o_orderkey AS case_id, o_orderpriority AS text, concat('{"a": {"b": ', CASE o_custkey % 5 WHEN 4 THEN 'null' ELSE CAST(o_custkey % 5 AS VARCHAR(20)) END, '}}') AS json, CASE WHEN o_orderkey % 20 = 0 THEN 'boom' END AS error, o_custkey % 6 AS table_rows FROM orders"""
_SCORES = "SELECT o_orderkey AS case_id, 'score' AS metric, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score FROM orders WHERE o_orderkey % 7 <> 0"


def _assertions(v: Inputs):
    rows = v.sql(_CHECKS).select("case_id", "type", F.lit("tom").alias("value").cast("string"), F.lit("a.b").alias("path"),
        F.lit("2").alias("expected"), F.col("min").cast("double").alias("min"), F.lit(0.6).alias("max"), F.lit("score").alias("metric"))
    rows = rows.withColumn("value", F.when(F.col("case_id") % 3 == 0, "HIGH").otherwise("URGENT"))
    return e.run_assertions(rows, v.sql(_OUTPUTS), v.sql(_SCORES))


def _cases(v: Inputs):
    lists = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return v.sql(_CASES).withColumn("suites", lists("suite")).withColumn("metrics", lists("metric"))


def _receipts(v: Inputs):
    words = v.sql("SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS w1, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_linestatus END AS w2, "
            "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS w3 FROM lineitem")
    return words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", F.array("w1", "w2", "w3").alias("w")))).alias("l")).select("doc_id", F.transform("l", lambda x: x["w"]).alias("lines"))


def _layouts(v: Inputs):
    rows = v.sql("SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('t', CAST(l_partkey AS STRING)) END AS "
            "t, l_partkey % 4 = 0 AS ig, l_suppkey AS s FROM lineitem")
    block = F.struct(F.col("ig").alias("ignore"), F.when(F.col("n") % 2 == 0, 10 - F.col("n")).alias("order"), F.col("t").alias("text"),
        F.when(F.col("s") % 2 == 0, F.concat(F.lit("x^"), F.col("s").cast("string"))).alias("latex"),
        F.concat(F.lit("<b>"), F.col("s").cast("string"), F.lit("</b>")).alias("html"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("l")).select("doc_id", F.transform("l", lambda x: x["b"]).alias("blocks"))


# a test for each line of an order: its quantity, one in three misprinted, right of its number or of one that no line has
_LINES = """SELECT l_orderkey * 8 + l_linenumber AS test_id, l_orderkey AS doc_id, 'table' AS type, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS INT) AS max_diffs,
    concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE CASE WHEN l_linenumber % 3 = 0 THEN '88'
        ELSE '' END END) AS cell,
    CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN '9' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS side FROM lineitem"""


def _table_tests(v: Inputs):
    none = F.lit(None).cast("string")
    tests = v.sql(_LINES).select("test_id", "doc_id", "type", "cell", "max_diffs", F.col("side").alias("left"),
        F.lit("quantity").alias("top_heading"), *[none.alias(c) for c in ("up", "down", "right", "left_heading")])
    return e.table_tests(tests, m.markdown_tables(v("md_docs")))


_FIELD = """m AS (SELECT coalesce(r.doc_id, p.doc_id) AS doc_id, coalesce(r.field, p.field) AS field, CASE WHEN r.v IS NOT DISTINCT FROM p.v THEN 1 ELSE 0 END AS tp, p.v IS NOT NULL AS hp, r.v IS NOT NULL AS hr
    FROM (SELECT doc_id, field, lower(value) AS v FROM ref_fields) r FULL OUTER JOIN (SELECT doc_id, field, lower(value) AS v
        FROM pred_fields) p ON r.doc_id = p.doc_id AND r.field = p.field)"""
_TOKENS = """SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(replace({c}, '*', '')), '\\s+')) AS token FROM text_pairs) WHERE token <> '' GROUP BY doc_id, token"""

PLANS = {
    "e01_text_error_rates": (lambda v: e.text_error_rates(v("text_pairs")).select("doc_id", *[F.round(c, 9).alias(c) for c in ("cer", "normalized_cer", "similarity")]), None),
    "e01_word_error_rates": (lambda v: e.text_error_rates(v("text_pairs")).select("doc_id", "wer"), None),
    "e01_value_error_rates": (lambda v: e.text_error_rates(v.sql(_VALUES)).select("doc_id", *[F.round(c, 9).alias(c) for c in ("cer", "normalized_cer", "similarity")]), f"""
        WITH {_EDITS} SELECT doc_id, round(d / n, 9) AS cer, round(nd / n, 9) AS normalized_cer, round(1 - nd / greatest(n, m), 9) AS similarity FROM e"""),
    "e01_corpus_rates": (lambda v: e.corpus_error_rates(v.sql(_VALUES)).select("documents", "edits", "chars", *[F.round(c, 9).alias(c) for c in ("cer", "normalized_cer")]), f"""
        WITH {_EDITS} SELECT count(*) AS documents, CAST(sum(d) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS chars, round(sum(d) / sum(n), 9) AS cer,
            round(sum(nd) / sum(n), 9) AS normalized_cer FROM e"""),
    "e01_corpus_text_rates": (lambda v: e.corpus_error_rates(v("text_pairs")), None),
    "e02_token_overlap": (lambda v: e.token_overlap(v("text_pairs")).select("doc_id", F.round("coverage", 9).alias("coverage"), F.round("unsupported", 9).alias("unsupported")), f"""
        WITH r AS ({_TOKENS.format(c="reference")}), p AS ({_TOKENS.format(c="concat(said, ' the end')")}), b AS (SELECT coalesce(r.doc_id,
            p.doc_id) AS doc_id, coalesce(r.n, 0) AS a, coalesce(p.n, 0) AS z FROM r FULL OUTER JOIN p ON r.doc_id = p.doc_id AND r.token = p.token),
          g AS (SELECT doc_id, sum(a) AS nr, sum(z) AS np, sum(least(a, z)) AS hit FROM b GROUP BY doc_id)
        SELECT t.doc_id, round(CASE WHEN coalesce(nr, 0) = 0 THEN 1 ELSE hit / nr END, 9) AS coverage, round(CASE WHEN coalesce(np, 0) = 0 THEN 0
            ELSE (np - hit) / np END, 9) AS unsupported FROM text_pairs t LEFT JOIN g ON t.doc_id = g.doc_id"""),
    "e03_field_scores": (lambda v: e.field_scores(v("ref_fields"), v("pred_fields"), "field"), f"""
        WITH {_FIELD}, g AS (SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(CAST(hp AS INT) - tp) AS BIGINT) AS fp,
            CAST(sum(CAST(hr AS INT) - tp) AS BIGINT) AS fn FROM m GROUP BY field),
          s AS (SELECT *, CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE
              WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS recall FROM g)
        SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END::DOUBLE AS f1 FROM s"""),
    "e04_critical_match": (lambda v: e.critical_match(_docs(v), v("ref_fields"), v("pred_fields"), ["total", "invoice_number"]), f"""
        WITH {_FIELD} SELECT o_orderkey AS doc_id, coalesce(n, 0) / 2 AS critical_match FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n FROM m
            WHERE field IN ('total', 'invoice_number') AND tp = 1 GROUP BY doc_id) x ON x.doc_id = o_orderkey"""),
    "e05_table_cell_scores": (lambda v: e.table_cell_scores(_docs(v), v("ref_cells"), v("pred_cells")).withColumn("cell_f1", F.round("cell_f1", 9)), """
        WITH r AS (SELECT doc_id, column_name AS c, lower(value) AS v, count(*) AS n FROM ref_cells WHERE trim(value) <> ''
            GROUP BY ALL), p AS (SELECT doc_id, column_name AS c, lower(value) AS v, count(*) AS n FROM pred_cells WHERE trim(value) <> '' GROUP BY ALL),
          g AS (SELECT coalesce(r.doc_id, p.doc_id) AS doc_id, sum(coalesce(r.n, 0)) AS a, sum(coalesce(p.n, 0)) AS b, sum(least(coalesce(r.n, 0),
              coalesce(p.n, 0))) AS t FROM r FULL OUTER JOIN p ON r.doc_id = p.doc_id AND r.c = p.c AND r.v = p.v GROUP BY 1)
        SELECT o_orderkey AS doc_id, round(CASE WHEN coalesce(a + b, 0) = 0 THEN 1 ELSE 2 * t / (a + b) END, 9) AS cell_f1
            FROM orders LEFT JOIN g ON g.doc_id = o_orderkey"""),
    "e06_presence_tests": (lambda v: e.presence_tests(v.sql("SELECT * FROM presence_view WHERE max_diffs = 0"), v.sql(_OUT)), f"""
        WITH x AS (SELECT t.*, {_unit("reference")} AS o, {_unit("text")} AS n FROM presence_view t JOIN text_pairs p ON t.doc_id = p.doc_id WHERE max_diffs = 0),
          y AS (SELECT *, CASE WHEN first_n IS NOT NULL AND last_n IS NOT NULL THEN concat(left(o, first_n), right(o, last_n))
              WHEN first_n IS NOT NULL THEN left(o, first_n) WHEN last_n IS NOT NULL THEN right(o, last_n) ELSE o END AS hay FROM x)
        SELECT test_id, doc_id, (type = 'present') = contains(CASE WHEN case_sensitive THEN hay ELSE lower(hay) END, CASE WHEN case_sensitive THEN n
            ELSE lower(n) END) AS passed FROM y"""),
    "e06_presence_with_edits": (lambda v: e.presence_tests(v("presence_view"), v.sql(_OUT)), f"""
        WITH x AS (SELECT t.*, CAST(max_diffs AS BIGINT) AS k, {_unit("reference")} AS o, {_unit("text")} AS n
            FROM presence_view t JOIN text_pairs p ON t.doc_id = p.doc_id),
          y AS (SELECT *, CASE WHEN first_n IS NOT NULL AND last_n IS NOT NULL THEN concat(left(o, first_n), right(o, last_n))
              WHEN first_n IS NOT NULL THEN left(o, first_n) WHEN last_n IS NOT NULL THEN right(o, last_n) ELSE o END AS cut FROM x),
          z AS (SELECT *, CASE WHEN case_sensitive THEN cut ELSE lower(cut) END AS hay, CASE WHEN case_sensitive THEN n ELSE lower(n) END AS needle FROM y),
          near AS (SELECT DISTINCT test_id FROM (SELECT test_id, k, needle, hay, unnest(range(1, length(hay) + 2)) AS i
              FROM (SELECT test_id, k, needle, {_bytes("hay")} AS hay FROM z WHERE k > 0)) WHERE {_near("needle", "hay")})
        SELECT z.test_id, doc_id, (type = 'present') = (contains(hay, needle) OR near.test_id IS NOT NULL) AS passed
            FROM z LEFT JOIN near ON near.test_id = z.test_id"""),
    "e07_order_tests": (lambda v: e.order_tests(v("order_view"), v.sql(_OUT)), f"""
        WITH x AS (SELECT t.test_id, t.doc_id, CAST(max_diffs AS BIGINT) AS k, {_unit("reference")} AS o, {_unit("before")} AS b, {_unit("after")} AS a
            FROM order_view t JOIN text_pairs p ON t.doc_id = p.doc_id),
          places AS (SELECT *, unnest(range(1, length(o) + 1)) AS i FROM (SELECT test_id, k, {_bytes("o")} AS o, b, a FROM x WHERE k > 0)),
          near AS (SELECT test_id, min(i) FILTER ({_near("b", "o")}) AS first, max(i) FILTER ({_near("a", "o")}) AS last FROM places GROUP BY test_id)
        SELECT x.test_id, doc_id, CASE WHEN k > 0 THEN coalesce(first < last, false)
            ELSE strpos(o, b) > 0 AND strpos(o, a) > 0 AND strpos(o, b) < CASE WHEN a = '' THEN length(o) ELSE length(o) - strpos(reverse(o),
                reverse(a)) - length(a) + 2 END END AS passed
        FROM x LEFT JOIN near ON near.test_id = x.test_id"""),
    "e08_table_tests": (_table_tests, f"""
        WITH t AS ({_LINES}), x AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS got FROM lineitem),
          p AS (SELECT test_id, cell AS want, got, max_diffs AS k FROM t JOIN x ON l_orderkey = doc_id AND line = side),
          c AS (SELECT *, list_max(list_transform(range(1, CAST(pow(2, length(want)) AS BIGINT)), lambda m: CASE WHEN got LIKE concat('%',
              array_to_string(list_transform(list_filter(range(1, length(want) + 1), lambda i: (m >> CAST(i - 1 AS BIGINT)) & 1 = 1), lambda i: substr(want, i,
              1)), '%'), '%') THEN bit_count(m) ELSE 0 END)) AS common FROM p),
          ok AS (SELECT test_id, bool_or(CASE WHEN k = 0 THEN want = got ELSE 2 * common / (length(want) + length(got)) >= greatest(0.5,
              1 - k / length(want)) END) AS ok FROM c GROUP BY test_id)
        SELECT t.test_id, doc_id, coalesce(ok, false) AS passed FROM t LEFT JOIN ok ON ok.test_id = t.test_id"""),
    "e09_unit_pass_rate": (lambda v: e.unit_pass_rate(_docs(v), v.sql("SELECT o_orderkey AS doc_id, o_custkey % 3 = 0 AS passed FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 6 = 0")), """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN (1 + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) / 2 WHEN o_orderkey % 3 = 0 THEN
            CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS unit_pass_rate FROM orders"""),
    "e10_run_assertions": (_assertions, f"""
        WITH x AS (SELECT c.case_id, c.type, CASE WHEN error IS NOT NULL THEN false ELSE coalesce(CASE kind WHEN 0 THEN contains(text, word)
            WHEN 1 THEN NOT contains(text, word) WHEN 2 THEN (json ->> '$.a.b') = '2' WHEN 3 THEN (json ->> '$.a.b') IS NOT NULL
            WHEN 4 THEN CAST(json ->> '$.a.b' AS DOUBLE) >= 2
            WHEN 5 THEN score >= 0.3 WHEN 6 THEN score <= 0.6 ELSE table_rows >= 3 END, false) END AS ok
          FROM (SELECT *, CASE WHEN case_id % 3 = 0 THEN 'HIGH' ELSE 'URGENT' END AS word FROM ({_CHECKS}) q) c JOIN ({_OUTPUTS}) o ON c.case_id = o.case_id
              LEFT JOIN ({_SCORES}) s ON s.case_id = c.case_id)
        SELECT case_id, bool_and(ok) AS passed, coalesce(array_to_string(list_sort(list_distinct(list(type) FILTER (NOT ok))), ','), '') AS failed FROM x
            GROUP BY case_id"""),
    "e11_weighted_score": (lambda v: e.weighted_score(v("case_results"), "mode"), "SELECT mode, CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) AS DOUBLE) AS score, avg(CAST(passed AS INT)) AS pass_rate FROM case_results GROUP BY mode"),
    "e12_metric_statistics": (lambda v: e.metric_statistics(v.sql(_METRICS)).select("metric", *[F.round(c, 9).alias(c) for c in ("mean", "min", "max", "std_dev")], "samples"), f"SELECT metric, round(avg(score), 9) AS mean, round(min(score), 9) AS min, round(max(score), 9) AS max, round(stddev_pop(score), 9) AS std_dev, count(*) AS samples FROM ({_METRICS}) GROUP BY metric"),
    "e13_breakdowns": (lambda v: e.breakdowns(v("case_results").withColumn("tags", F.array("tag", "tag2"))).select("kind", "name", "cases", "passes", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("pass_rate", "mean_metric", "mean_duration_ms", "mean_tokens", "total_cost")]), """
        WITH t AS (SELECT 'all' AS kind, NULL AS name, * FROM case_results UNION ALL SELECT 'mode', mode, * FROM case_results UNION ALL SELECT 'tag', tag, *
            FROM case_results UNION ALL SELECT 'tag', tag2, * FROM case_results WHERE tag2 <> tag)
        SELECT kind, name, count(*) AS cases, count(*) FILTER (passed) AS passes, round(avg(CAST(passed AS INT)), 6) AS pass_rate, round(avg(metric),
            6) AS mean_metric, round(avg(duration_ms), 6) AS mean_duration_ms, round(avg(tokens), 6) AS mean_tokens, round(CAST(sum(cost) AS DOUBLE),
            6) AS total_cost FROM t GROUP BY ALL"""),
    "e14_suite_gate": (lambda v: e.suite_gate(v("case_results")), "SELECT CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) AS DOUBLE) AS score, count(*) FILTER (NOT passed) AS failing, count(*) FILTER (NOT passed) > 0 OR sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) < 0.75 AS failed FROM case_results"),
    "e15_failure_report": (lambda v: e.failure_report(v("case_results")), "SELECT case_id, count(*) AS failures, concat('case ', case_id, ' failed ', count(*), ' times, first in repeat ', min(repeat_no)) AS message FROM case_results WHERE NOT passed GROUP BY case_id"),
    "e16_provider_matrix": (lambda v: e.provider_matrix(v("case_results")).withColumn("mean_metric", F.round("mean_metric", 9)), """
        WITH g AS (SELECT route, count(*) AS cases, avg(CAST(passed AS INT)) AS pass_rate, CAST(sum(CASE WHEN passed THEN weight
            ELSE 0 END) / sum(weight) AS DOUBLE) AS score, avg(metric) AS mm FROM case_results GROUP BY route)
        SELECT route, cases, pass_rate, score, round(mm, 9) AS mean_metric, CASE WHEN score >= 0.75 THEN 'passed' ELSE 'failed' END AS status,
            CAST(dense_rank() OVER (ORDER BY mm DESC) AS INT) AS rank FROM g"""),
    "e17_repeat_stability": (lambda v: e.repeat_stability(v("case_results")).withColumn("std_dev", F.round("std_dev", 9)), "SELECT case_id, count(*) AS repeats, round(stddev_pop(metric), 9) AS std_dev, count(DISTINCT passed) > 1 AS flips FROM case_results GROUP BY case_id"),
    "e18_sample_by_hash": (lambda v: e.sample_by_hash(v.sql("SELECT doc_id, source FROM documents"), "source", "doc_id", "s1", 5), "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat('s1', CAST(doc_id AS VARCHAR)))) <= 5"),
    "e19_lines_from_words": (lambda v: e.lines_from_words(_receipts(v)), """
        SELECT l_orderkey AS doc_id, string_agg(concat_ws(' ', l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END, CASE
            WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END), chr(10) ORDER BY l_linenumber, l_returnflag, CASE
            WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_linestatus END, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END) AS text
            FROM lineitem GROUP BY l_orderkey"""),
    "e20_text_from_blocks": (lambda v: e.text_from_blocks(_layouts(v)), """
        WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey % 4 = 0 AS ig, CASE WHEN l_linenumber % 2 = 0 THEN 10 - l_linenumber END AS o,
            CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('t', CAST(l_partkey AS VARCHAR)) END AS t,
            CASE WHEN l_suppkey % 2 = 0 THEN concat('x^', CAST(l_suppkey AS VARCHAR)) END AS lx, CAST(l_suppkey AS VARCHAR) AS h FROM lineitem),
          y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, ig, o NULLS FIRST, t, lx NULLS FIRST, concat('<b>', h, '</b>')) AS i FROM x)
        SELECT doc_id, string_agg(CASE WHEN t <> '' THEN t WHEN lx IS NOT NULL THEN lx ELSE h END, chr(10) ORDER BY o IS NULL, o, i) AS text FROM y
            WHERE NOT ig GROUP BY doc_id"""),
    "e21_select_unit_tests": (lambda v: e.select_unit_tests(v.sql(_UNIT)), f"""
        WITH d AS (SELECT category, doc_id, count(*) AS tests FROM ({_UNIT}) WHERE checked AND type <> 'math' AND page = 1 GROUP BY ALL HAVING count(*) >= 3)
        SELECT category, doc_id, tests FROM d QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256(concat('seed', CAST(doc_id AS VARCHAR)))) <= 5"""),
    "e22_check_cases": (lambda v: e.check_cases(_cases(v)), f"""
        WITH c AS ({_CASES}) SELECT case_id, 'duplicate-id' AS issue FROM c GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT case_id, 'bad-mode' FROM c
            WHERE mode IS NULL OR mode = 'other' UNION ALL SELECT case_id, 'no-preset' FROM c WHERE mode = 'template' AND coalesce(trim(preset_id), '') = ''
        UNION ALL SELECT case_id, 'no-assertions' FROM c WHERE assertions = 0 UNION ALL SELECT case_id, 'bad-threshold' FROM c
            WHERE threshold > 1 AND mode = 'agentic' UNION ALL SELECT case_id, 'bad-iterations' FROM c WHERE max_iterations < 1 AND mode = 'agentic'
        UNION ALL SELECT case_id, 'bad-suite' FROM c WHERE suite = 'smoke' UNION ALL SELECT case_id, 'unknown-metric' FROM c WHERE metric = 'bleu'"""),
}
