"""Golden rows and invariants of the library's own operators."""

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions.distance import _edit, found_within, indel_ratio
from quire.operators import batch, candidates, presets, resume, scoring, structure, usage, web
from quire.sources import discovery
from quire.streaming import jobs, stateful


def amounts(spark, kind, values, currency=None):
    rows = [(i, "f", v, 0.5) for i, v in enumerate(values)]
    fields = spark.createDataFrame(rows, "doc_id long, field string, value string, confidence double")
    rules = spark.createDataFrame([("f", kind)], "field string, type string")
    cur = spark.createDataFrame([(i, currency) for i in range(len(values))], "doc_id long, currency string") if currency else None
    return [r for r in presets.normalize_fields(fields, rules, cur).orderBy("doc_id").collect()]


def test_amount_formats(spark):
    cases = {"1,234.56": "1234.56", "1.234,56": "1234.56", "1 234,5": "1234.50", "1'234.5": "1234.50", "-$5": "-5.00", "USD -5.00": "-5.00",
        "5.00-": "-5.00", "(27.00)": "-27.00", "−3": "-3.00", "Rs.500": "500.00", "S/.100": "100.00", "Fr.25": "25.00", "No.5": "No.5",
        "USD.50": "USD.50", ".5": "0.50", ",5": "0.50", "0.125": "0.125", "1.234": "1234.00", "1.234.567": "1234567.00", "1,23,4": "1,23,4",
        "3 @ 5.00": "3 @ 5.00", "0.500": "0.500", "": "", "-0": "0.00", "n/a": "n/a"}
    got = {v: r["value"] for v, r in zip(cases, amounts(spark, "currency", list(cases)))}
    assert got == cases


def test_three_decimals_and_warnings(spark):
    rows = amounts(spark, "currency", ["1.234", "1,234", "5", "BHD 1.2"], "KWD")
    assert [r["value"] for r in rows] == ["1.234", "1.234", "5.000", "1.200"]
    assert [r["warning"] for r in rows] == ["ambiguous-separator", "ambiguous-separator", None, None]
    numbers = amounts(spark, "number", ["1,234", "1.234", "x"])
    assert [r["number"] for r in numbers] == [1234.0, 1.234, None]


def test_lists_and_booleans(spark):
    assert amounts(spark, "list", ["a, b\nc,,"])[0]["items"] == ["a", "b", "c"]
    assert [r["value"] for r in amounts(spark, "boolean", ["Yes", "FALSE", "maybe"])] == ["true", "false", "maybe"]


def test_urls_are_judged(spark):
    good = ["https://e.org", "http://e.org/a b"[:14], "e.org:8080/x", "localhost:3000", "10.0.0.1/x", "[::1]/x"]
    bad = ["javascript:alert(1)", "data:x", "java\tscript:1", "http://u:p@e.org", "just text", "12345", "file:///x", "ht\ttp://e.org"]
    rows = spark.createDataFrame([(i, "site", v) for i, v in enumerate(good + bad)], "doc_id long, field string, value string")
    got = presets.check_types(rows, spark.createDataFrame([("site", "url")], "field string, type string")).orderBy("doc_id").collect()
    assert [r["value"] for r in got] == good + [None] * len(bad)


def test_text_scores(spark):
    p = spark.createDataFrame([(1, "invoice 42 total", "invoice 4Z total invented"), (2, "", ""), (3, "", "x"), (4, "a b c", "")], "doc_id long, reference string, prediction string")
    o = {r["doc_id"]: r for r in scoring.token_overlap(p).collect()}
    assert o[1]["coverage"] == pytest.approx(2 / 3) and o[1]["unsupported"] == pytest.approx(1 / 2)
    assert (o[2]["coverage"], o[2]["unsupported"], o[4]["coverage"]) == (1.0, 0.0, 0.0)
    e = {r["doc_id"]: r for r in scoring.text_error_rates(p).collect()}
    assert (e[2]["cer"], e[3]["cer"], e[4]["wer"]) == (0.0, 1.0, 1.0) and e[1]["wer"] == pytest.approx(2 / 3)
    rows = [(1, "# “Café” — ﬁve", '"café" - five'), (2, "Total 5", "**Total** 5\n"), (3, "a\r\nb", "a\nb"), (4, "x😀y", "xy"), (5, "日本語 文書", "天気 予報"),
        (6, "one two", "# [one](u)\n> ![two](v)"), (7, "code line", "```py\ncode `line`\n```"), (8, "a b", "1. a\n- b")]
    u = spark.createDataFrame(rows, "doc_id long, reference string, prediction string")
    e = {r["doc_id"]: r for r in scoring.text_error_rates(u).collect()}
    assert [e[i]["normalized_cer"] for i in (1, 2, 3, 6, 7, 8)] == [0.0] * 6 and [e[i]["cer"] for i in (2, 3, 7)] == [0.0] * 3
    assert e[4]["cer"] == pytest.approx(1 / 4) and e[5]["wer"] == 1.0
    o = {r["doc_id"]: (r["coverage"], r["unsupported"]) for r in scoring.token_overlap(u).collect()}
    assert o[5] == (0.0, 1.0) and o[2] == (1.0, 0.0) and o[6] == (1.0, 0.0)


def test_field_scores(spark):
    ref = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "3")], "doc_id long, field string, value string")
    got = spark.createDataFrame([(1, "a", "1"), (1, "b", "9"), (1, "d", "4")], "doc_id long, field string, value string")
    s = scoring.field_scores(ref, got).first()
    assert all(s[k] == pytest.approx(1 / 3) for k in ("precision", "recall", "f1"))
    docs = ref.select("doc_id").distinct()
    assert scoring.critical_match(docs, ref, got, ["a", "b"]).first()["critical_match"] == 0.5
    assert scoring.critical_match(docs, ref, got, []).first()["critical_match"] == 1.0


def test_edit_distances(spark):
    assert _edit("kitten", "sitting") == 3 and _edit("", "abc") == 3 and _edit("abc", "") == 3
    assert _edit("brown", "the quick brwn fox", True) == 1 and _edit("zz", "", True) == 2
    row = (spark.createDataFrame([("abcd", "bcde", "abd", 1, 0)], "a string, b string, c string, k int, z int")
        .select(indel_ratio("a", "b").alias("r"), found_within("c", "a", "k").alias("d"), found_within("c", "a", "z").alias("n")).first())
    assert row["r"] == pytest.approx(0.75) and row["d"] and not row["n"]


def test_merging_is_ordered_and_keeps_locations(spark):
    rows = [(1, 1, "f", "bad", 0.99, False, 5, 7), (1, 2, "f", "good", 0.5, True, 1, None), (1, 3, "f", "tie", 0.5, True, 1, None),
        (1, 4, "f", "late", 0.4, True, 9, 3), (2, 1, "f", "only", None, None, None, None)]
    c = spark.createDataFrame(rows, "doc_id long, seq long, field string, value string, confidence double, is_valid boolean, extracted_at long, page long")
    for parts in (1, 3):
        got = {r["doc_id"]: r for r in candidates.merge_candidates(c.repartition(parts)).collect()}
        assert got[1]["value"] == "tie" and got[1]["page"] == 7 and got[2]["value"] == "only"


def test_dates_subtotals_and_order(spark):
    v = spark.createDataFrame([("2024-02-30",), ("05/06/2024",), ("13/06/2024",), ("2024-02-29 10:00",), ("2024-02-29 25:00",), ("x",)], "v string").select(F.size(candidates.date_readings("v"))
        .alias("n"))
    assert [r["n"] for r in v.collect()] == [0, 2, 1, 1, 0, 0]
    a = spark.createDataFrame([("$1,234.56",), ("1.234,50",), ("1,234",), ("1,5",), ("none",)], "v string").select(candidates.parse_amount("v").alias("n"))
    assert [r["n"] for r in a.collect()] == [1234.56, 1234.5, 1234.0, 1.5, None]
    f = spark.createDataFrame([(1, "subtotal", "10"), (1, "item_count", "2"), (1, "item_1_amount", "4"), (1, "line_item_2_total", "6.04"),
            (2, "subtotal", "10"), (2, "item_count", "2"), (2, "item_1_amount", "4"), (2, "item_2_amount", "7"), (3, "subtotal", "1")],
        "doc_id long, field string, value string")
    assert {r["doc_id"]: r["ok"] for r in candidates.check_subtotals(f).collect()} == {1: True, 2: False, 3: True}


def test_readiness_and_completion(spark):
    docs = spark.createDataFrame([(1, "invoice"), (2, "unknown"), (3, "unknown"), (4, "form")], "doc_id long, document_type string")
    need = spark.createDataFrame([("invoice", "a"), ("invoice", "b"), ("form", None)], "document_type string, field string")
    f = spark.createDataFrame([(1, "a", "x", 1.4, True), (1, "b", "y", 0.5, False), (2, "z", "1", 0.9, True)], "doc_id long, field string, value string, confidence double, is_valid boolean")
    r = {x["doc_id"]: x for x in candidates.readiness(docs, f, need).collect()}
    assert (r[1]["coverage"], r[1]["missing"], r[1]["confidence"]) == (0.5, "b", 0.75) and [r[i]["coverage"] for i in (2, 3, 4)] == [1.0, 0.0, 1.0]
    done = {x["doc_id"]: x["reason"] for x in candidates.completion(candidates.readiness(docs, f, need), 0.8).collect()}
    assert done == {1: "missing-required-fields", 2: "confidence-and-coverage-met", 3: "no-fields", 4: "no-fields"}


def test_refinement_equals_brute_force(spark):
    """Three passes over documents whose candidates get better, stay as they are, or never come."""
    found = {1: {1: [("a", "x", 0.5)], 2: [("b", "y", 0.9)]}, 2: {1: [("a", "x", 0.9), ("b", "y", 0.9)]}, 3: {},
        4: {1: [("a", "x", 0.2)], 2: [("a", "x", 0.2)]}, 5: {1: [("a", "p", 0.1)], 2: [("a", "q", 0.2)], 3: [("a", "r", 0.3)]}}
    asked = []

    def extract(docs, i):
        open_ = sorted(r["doc_id"] for r in docs.collect())
        asked.append(open_)
        rows = [(d, n, f, v, c, True, i, None) for d in found for n, (f, v, c) in enumerate(found[d].get(i, []))]
        return spark.createDataFrame(rows, "doc_id long, seq long, field string, value string, confidence double, is_valid boolean, extracted_at long, page long")

    docs = spark.createDataFrame([(d, "pair") for d in found], "doc_id long, document_type string")
    need = spark.createDataFrame([("pair", "a"), ("pair", "b")], "document_type string, field string")
    kept, passes = candidates.iterative_refine(docs, extract, need, 3, 0.6)
    assert asked == [[1, 2, 3, 4, 5], [1, 3, 4, 5], [5]]
    ends = {r["doc_id"]: (r["iteration"], r["stop_reason"]) for r in passes.where("stop_reason is not null").collect()}
    assert ends == {2: (1, "confidence-and-coverage-met"), 1: (2, "confidence-and-coverage-met"), 3: (2, "no-progress"), 4: (2, "no-progress"), 5: (3, "max-iterations")}
    assert sorted((r["doc_id"], r["field"], r["value"]) for r in kept.collect()) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (4, "a", "x"), (5, "a", "r")]


def test_refinement_deals_candidates_once(spark):
    """A pass deals its candidates by document once, and the documents and their states once each; it used to read what it merged several times."""
    need = spark.createDataFrame([("pair", "a")], "document_type string, field string")
    rows = spark.range(20_000).selectExpr("id % 2000 AS doc_id", "id AS seq", "concat('f', id div 2000) AS field", "sha2(cast(id AS string), 256) AS value", "0.1D AS confidence",
        "true AS is_valid", "0L AS extracted_at", "cast(null AS bigint) AS page")
    docs = spark.range(2000).selectExpr("id AS doc_id", "'pair' AS document_type")
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = {x.stageId() for x in _all(spark, store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    kept, passes = candidates.iterative_refine(docs, lambda open_, i: rows, need, 1, 0.5)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = _all(spark, store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    assert sum(x.shuffleWriteRecords() for x in stages if x.stageId() not in seen) <= 20_000 + 2 * 2000
    assert kept.count() == 20_000 and passes.count() == 2000


def _all(spark, sequence):
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sequence))


def test_resume_twice_is_no_work(spark):
    docs = spark.createDataFrame([("a", "f1", "l1"), ("b", "f2", "l2"), ("c", "f3", "l3")], "source string, fingerprint string, legacy_fingerprint string")
    schema = "source string, fingerprint string, fingerprint_version int, status string, output_files array<string>, owned_files array<string>, updated long"
    m = spark.createDataFrame([("a", "f1", 2, "succeeded", ["o/a.md"], ["o/a.md"], 1), ("b", "l2", None, "succeeded", ["o/b.md"], ["o/b.md"], 1),
            ("c", "f3", 2, "partial", ["o/c.md"], ["o/c.md"], 1)], schema)
    files = spark.createDataFrame([("o/a.md",), ("o/b.md",), ("o/c.md",)], "path string")
    plan = {r["source"]: (r["action"], r["reason"], r["legacy"]) for r in resume.plan_incremental(docs, m, files).collect()}
    assert plan == {"a": ("resume", "unchanged", False), "b": ("resume", "unchanged", True), "c": ("extract", "partial", False)}
    assert resume.plan_incremental(docs, m, files.where("path <> 'o/a.md'")).where("source = 'a'").first()["reason"] == "missing-output"
    base = m.select("source", "fingerprint", "status", "output_files", "owned_files", "updated")
    new = spark.createDataFrame([("c", "f3", "succeeded", ["o/c.json"], ["o/c.json"], 2)], base.schema)
    once = resume.merge_manifest(base, new)
    twice = resume.merge_manifest(once, new)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    assert once.where("source = 'c'").first()["owned_files"] == ["o/c.json", "o/c.md"]


def test_a_manifest_stored_by_source_is_not_shuffled(spark):
    schema = "source string, fingerprint string, fingerprint_version int, status string, output_files array<string>, owned_files array<string>, updated long"
    old = spark.createDataFrame([(f"s{i}", f"f{i}", 2, "succeeded" if i % 3 else "partial", [f"o/{i}.md"], [f"o/{i}.md"], i) for i in range(50)] + [("s1",
                "f1", 2, "failed", ["o/x"], ["o/y"], 99)], schema)
    new = spark.createDataFrame([(f"s{i}", f"g{i}", 2, "succeeded", [f"o/{i}.json"], [], 60) for i in range(40, 60)] + [("s2", "g2", 2, "failed", [], ["o/late"], 0)], schema)
    base = ["source", "fingerprint", "status", "output_files", "owned_files", "updated"]
    try:
        stored = resume.save_manifest(old, "quire_manifest", 8)
        want = resume.latest_entries(old.select(*base).unionByName(new.select(*base)))
        merged = resume.merge_manifest(stored.select(*base), new.select(*base))
        assert sorted(map(repr, merged.collect())) == sorted(map(repr, want.collect())) and merged.count() == 60
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = resume.merge_manifest(stored.select(*base), new.select(*base))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Bucketed: true")]  # the manifest's side comes first
        docs = spark.createDataFrame([(f"s{i}", f"f{i}", None) for i in range(70)], "source string, fingerprint string, legacy_fingerprint string")
        planned = resume.plan_incremental(docs, stored, spark.createDataFrame([(f"o/{i}.md",) for i in range(50)], "path string"))
        lines = planned._jdf.queryExecution().executedPlan().toString().splitlines()
        joined = [i for i, x in enumerate(lines) if "FileScan" in x and "status" in x.split("Bucketed")[0]]
        assert joined and all("Exchange" not in x for i in joined for x in lines[i - 3 : i])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS quire_manifest")


def test_admission_stays_below_cap_and_last(spark):
    rows = [(1, i, i, 0.1 * (i % 5), None if i % 7 else "resumed") for i in range(5000)]
    d = spark.createDataFrame(rows, "run_id long, pos long, doc_id long, cost double, skip_reason string")
    got = usage.cost_admission(d, 20.0, bucket=100).join(d.select("pos", "cost", "skip_reason"), "pos")
    spent = got.where("admitted and skip_reason is null").agg(F.sum("cost").alias("s")).first()["s"]
    assert 20.0 <= spent < 20.5
    assert got.where("not admitted and skip_reason = 'resumed'").count() == 0


def test_extraction_never_loses_a_document(spark):
    def flaky():
        seen = {}

        def call(doc):
            seen[doc["id"]] = seen.get(doc["id"], 0) + 1
            if doc["id"] % 3 == 0:
                raise ValueError("broken")
            if doc["id"] % 3 == 1 and seen[doc["id"]] < 3:
                error = RuntimeError("busy")
                error.retryable = True
                raise error
            return {"text": "ok"}

        return call

    docs = spark.range(30).select(F.col("id"), F.lit("t").alias("text"))
    got = {r["id"]: (r["status"], r["attempts"]) for r in batch.extract_batch(docs, flaky, partitions=3).collect()}
    assert got == {i: (("failed", 1), ("succeeded", 3), ("succeeded", 1))[i % 3] for i in range(30)}


def test_secrets(spark):
    rows = spark.createDataFrame([("Bearer abc.d sk-12345678 AIzaABCDEFGHIJK api-key='zz' my p%40ss%2Fwordy p@ss/wordy",)], "text string")
    got = batch.redact_secrets(rows, known_secrets=["p@ss/wordy", "short"]).first()
    assert got["redacted"] == "Bearer [REDACTED] [REDACTED_KEY] [REDACTED_KEY] api-key=[REDACTED]' my [REDACTED_KEY] [REDACTED_KEY]"
    assert (got["n_bearer"], got["n_key"], got["n_google"], got["n_assignment"]) == (1, 1, 1, 1) and "p@ss" not in got["redacted"]


def test_markdown_structure(spark):
    text = "Intro\n# Title\nbody\n```\n# not\n```\n\nSetext\n------\nx\n## Two ##\n    # indented\n"
    got = structure.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["heading"], r["level"]) for r in got] == [(None, None), ("Title", 1), ("Setext", 2), ("Two", 2)]
    assert got[1]["lines"] == ["body", "```", "# not", "```"]
    cases = {"para one\nline two\n---": [], "one\n===\n\ntwo\n---\n---": ["one", "two"], "- item\n---": [], "x\n\n---\n===": ["---"],
        "~~~ a`b\n# no\n~~~\n# yes": ["yes"], "```a`b\n# yes": ["yes"], "#\tT ##": ["T"], "#no": [], "    # no": [], "# \n## b": ["", "b"],
        "````\n```\n# no": []}
    got = structure.markdown_sections(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).where("heading is not null").orderBy("doc_id", "section").collect()
    assert [[r["heading"] for r in got if r["doc_id"] == i] for i in range(len(cases))] == list(cases.values())
    html = "<table><thead><tr><th rowspan=0>A</th><td>b</td></tr></thead><tr><td>c</td></tr></table>"
    cells = structure.html_table_cells(spark.createDataFrame([(1, html)], "doc_id long, html string")).collect()
    assert {(r["row_no"], r["col_no"], r["text"], r["is_heading"]) for r in cells} == {(0, 0, "A", True), (1, 0, "A", True), (0, 1, "b", True), (1, 1, "c", False)}


def test_html_tables_are_read_as_tokens(spark):
    def cells(html):
        return {(r["table_no"], r["row_no"], r["col_no"]): (r["text"], r["is_heading"]) for r in structure.html_table_cells(spark.createDataFrame([(1, html)], "doc_id long, html string")).collect()}

    assert cells('<table><!-- <tr><td>no</td></tr> --><tr title="a > b"><td data-x=\'</td>\'>a &amp; b<br>c</td><TH>h</TH></tr></table>') == {(1, 0, 0): ("a & b\nc", False), (1, 0, 1): ("h", True)}
    nested = cells("<table><tr><td>out <table><tr><td>in</td><td>two</td></tr></table> end</td><td>next</td></tr><tr><td>last</td></tr></table>")
    assert nested == {(1, 0, 0): ("out intwo end", False), (1, 0, 1): ("next", False), (1, 1, 0): ("last", False), (2, 0, 0): ("in", False), (2, 0, 1): ("two", False)}
    assert cells("<table><tr><td>a<td>b<tr><td>c</table><p><table><td>x") == {(1, 0, 0): ("a", False), (1, 0, 1): ("b", False), (1, 1, 0): ("c", False), (2, 0, 0): ("x", False)}
    assert cells("<table><tr><td><script>'<td>'</script>1 < 2</td><td colspan=0 rowspan='x'>y</td></tr></table>") == {(1, 0, 0): ("'<td>'1 < 2", False), (1, 0, 1): ("y", False)}
    assert cells("<table><tr><td rowspan=2 colspan=2>w</td><td>a</td></tr><tr><td>b</td></tr></table>") == {(1, y, x): ("w", False) for y in (0, 1)
            for x in (0, 1)} | {(1, 0, 2): ("a", False), (1, 1, 2): ("b", False)}


def test_many_known_secrets_in_one_pass(spark):
    rng = random.Random(5)
    secrets = ["".join(rng.choice("abcd") for _ in range(rng.randrange(8, 14))) for _ in range(3000)] + ["p@ss/word" + str(i) for i in range(20)] + ["short", " padded-secret "]
    texts = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 5, 60, 300]))) for _ in range(60)] + ["x p%40ss%2Fword3 and p@ss/word19.", "padded-secret", None, ""]
    want = []
    for t in texts:
        for s in batch.known_spellings(secrets):
            t = t if t is None else t.replace(s, "[REDACTED_KEY]")
        want.append(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    made = batch.redact_secrets(rows, known_secrets=secrets)
    assert [r["redacted"] for r in made.orderBy("i").collect()] == want and sum(t != w for t, w in zip(texts, want)) > 20
    size = lambda n: len(batch.redact_secrets(rows, known_secrets=secrets[:n])._jdf.queryExecution().toString())
    assert size(3000) < 1.1 * size(100)


def test_rules_inside_arrays(spark):
    rules = [(1, "items", "array", True, None), (2, "items[].price", "number", True, 0.0), (3, "items[].parts[].id", "integer", True, None),
        (4, "grid[][]", "number", False, None), (5, "meta.tags[]", "string", False, None)]
    schema = spark.createDataFrame([(*r[:4], None, r[4], None) for r in rules], "pos int, property string, type string, required boolean, enum array<string>, minimum double, maximum double")
    texts = {1: '{"items": [{"price": 1, "parts": [{"id": 1}, {"id": 1.5, "x": 0}]}, {"price": -1, "parts": []}, {"parts": 5}, 7], "grid": [[1, "a"], 2, '
            '["b"]], "meta": {"tags": ["t", 1], "other": 2}, "top": 1}', 2: '{"items": []}', 3: "{", 4: "[]", 5: None, 6: '{"items": {"price": 1}}'}
    got = presets.validate_outputs(spark.createDataFrame(list(texts.items()), "doc_id long, json string"), schema, n=20).orderBy("doc_id", "n").collect()
    assert [(r["property"], r["issue"]) for r in got if r["doc_id"] == 1] == [("items[1].price", "minimum"), ("items[2].price", "missing"),
        ("items[0].parts[1].id", "type"), ("grid[0][1]", "type"), ("grid[2][0]", "type"), ("meta.tags[1]", "type"), ("meta.other", "unexpected"),
        ("top", "unexpected"), ("items[0].parts[1].x", "unexpected")]
    assert {r["doc_id"]: (r["property"], r["issue"]) for r in got if r["doc_id"] > 1} == {3: ("", "not-json"), 4: ("items", "missing"), 5: ("", "not-json"), 6: ("items", "type")}
    rows = spark.createDataFrame([(1, texts[1]), (1, texts[2])], "doc_id long, json string")
    plan = presets.validate_outputs(rows, schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("parseJson(") == 1  # a row is judged where it lies, its text read once
    few = presets.validate_outputs(spark.createDataFrame([(1, texts[1])], "doc_id long, json string"), schema, n=2).collect()
    assert [(r["n"], r["property"], r["more"]) for r in few] == [(1, "items[1].price", 7), (2, "items[2].price", 7)]


def test_candidate_shapes(spark):
    mails = {"a@b.c": True, "a@b": False, "@b.c": False, "a b@c.d": False, "a@.c": False, "a@b.": False, "a@b@c.d": False, "x@y..z": True}
    phones = {"+1 (555) 123-4567": True, "5551234567": True, "555-1234": False, "+": False, "1+5551234567": False, "555.123.4567": False}
    dates = {"2024-02-29": True, "2024-02-29T10:00": True, "29/02/2024 23:59:59": True, "2024-13-01": False, "2024-01-01 24:00": False, "1/2/2024": False, "01-02/2024": False}
    amounts = {"1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "1,5": 1.5, "1,500": 1500.0, "12,345,6": 123456.0, "1.2.3": None, "-5.": -5.0,
        "$ .5": 0.5, ".": None, "5-3": None, "1,234.5,6": None, "7": 7.0, "": None}
    rows = [(v, r) for r, cases in (("email", mails), ("phone", phones), ("date", dates), ("currency", amounts)) for v in cases]
    got = candidates.validate_candidates(spark.createDataFrame([(i, "f", v, r) for i, (v, r) in enumerate(rows)], "doc_id long, field string, value string, rule string")).orderBy("doc_id").collect()
    want = [*mails.values(), *phones.values(), *dates.values(), *(a is not None for a in amounts.values())]
    assert [(r["value"], r["valid"]) for r in got] == [(v, w) for (v, _), w in zip(rows, want)]
    said = {r["value"]: r["message"] for r in got}
    assert (said["555-1234"], said["+"], said["2024-13-01"], said["2024-02-29"]) == ("Valid phone format", "Invalid phone format", "Invalid date or time", "Valid date")
    read = spark.createDataFrame([(a,) for a in amounts], "v string").select("v", candidates.parse_amount("v").alias("n")).collect()
    assert {r["v"]: r["n"] for r in read} == amounts
    typed = {"2024-02-30": "date", "2024-02-29": None, "2024-02-29T10:00:00.125Z": None, "2024-02-29 1:00": "date", "20240229": "date"}
    rules = spark.createDataFrame([("d", "date"), ("m", "email")], "field string, type string")
    found = presets.check_types(spark.createDataFrame([(1, "d", v) for v in typed] + [(1, "m", "mailto:a@b.cd"), (1, "m", "a@b.c"),
                (1, "m", "a(b)@c.de")], "doc_id long, field string, value string"), rules)
    warned = {r["value"]: r["warning"] for r in found.collect()}
    assert warned == {**{v: w and "not-iso-date" for v, w in typed.items()}, "mailto:a@b.cd": None, "a@b.c": "odd-email", "a(b)@c.de": "odd-email"}


def test_url_policy(spark):
    cases = {"https://e.org/x": None, "http://127.0.0.1/": "private-address", "http://[::1]/": "private-address", "http://[2606:4700::1]/": None,
        "http://8.8.8.8/": None, "http://u@e.org/": "credentials", "ftp://e.org": "scheme", "http://LOCALHOST/": "loopback",
        "https://x.ngrok.io": "tunnel", "http://172.20.1.1": "private-address"}
    got = web.filter_urls(spark.createDataFrame([(u,) for u in cases], "url string")).collect()
    assert {r["url"]: r["reason"] for r in got} == cases
    keys = spark.createDataFrame([("HTTP://E.org/a/#f",), ("http://e.org/a?x=1#y",), ("http://e.org",)], "url string").select(web.url_key("url").alias("k")).collect()
    assert [r["k"] for r in keys] == ["http://e.org/a", "http://e.org/a?x=1", "http://e.org/"]


def test_blocklists(spark):
    listed = [("suffix", "bad.example"), ("suffix", "*.Evil.test."), ("cidr", "203.0.112.0/23"), ("cidr", "8.8.4.4"), ("cidr", "2001:DB9::/32"),
        ("cidr", "2600:1::ffff:1.2.3.4/128"), ("cidr", "0.0.0.0/33"), ("cidr", "x/8"), ("cidr", None), ("other", "e.org"), (None, "e.org"),
        ("suffix", "")]
    cases = {"http://bad.example/": "blocked", "http://a.b.BAD.example./": "blocked", "http://notbad.example/": None, "http://evil.test/x": "blocked",
        "http://e.org/": None, "http://8.8.4.4/": "blocked", "http://8.8.4.5/": None, "http://134743044/": "blocked",
        "http://203.0.112.7/": "blocked", "http://203.0.114.1/": None, "http://[2001:db9:5::1]/": "blocked", "http://[2001:dba::1]/": None,
        "http://[2600:1::ffff:102:304]/": "blocked", "http://[2600:1::ffff:102:305]/": None, "ftp://bad.example/": "scheme",
        "http://10.0.0.1/": "private-address"}
    urls = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    lists = spark.createDataFrame(listed, "kind string, value string")
    assert {r["url"]: r["reason"] for r in web.filter_urls(urls, lists).collect()} == {**cases, None: None}
    assert {r["url"]: r["reason"] for r in web.filter_urls(urls, lists.where("false")).collect()} == {**{u: None if r == "blocked" else r for u, r in cases.items()}, None: None}
    plan = web.filter_urls(urls, lists)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_combined_pages_lose_none(spark):
    rows = [(1, "One", "http://h/1", "text"), (2, None, "http://h/2", "other"), (3, " ", None, "third"), (4, "Four", "http://h/4", None), (5, None, None, "text")]
    got = web.combine_pages(spark.createDataFrame([("h", *r) for r in rows], "site string, pos long, title string, url string, text string"), "site").first()
    assert got["pages"] == 4 and got["combined"].split(web.RULE) == ["# One\nSource: http://h/1\n\ntext", "# http://h/2\nSource: http://h/2\n\nother",
        "# \nSource: \n\nthird", "# Four\nSource: http://h/4\n\n"]


def test_no_rules_no_findings(spark):
    fields = spark.createDataFrame([(1, "a", "x")], "doc_id long, field string, value string")
    rules = spark.createDataFrame([], "pos int, field string, required boolean, pattern string")
    found = presets.validate_rules(fields.select("doc_id"), fields, rules)
    assert found.collect() == [] and found.columns == ["doc_id", "field", "issue", "entry"]


def test_scan_write_and_chunk(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "dist/c.png", ".h/d.png", "sub/e.JPG"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    got = {r["path"]: r["verdict"] for r in discovery.scan_documents(spark, [str(tmp_path)]).collect()}
    assert got["root/a.pdf"] == "supported" and got["root/b.txt"] == "unsupported" and got["root/dist/c.png"] == "excluded" and got["root/sub/e.JPG"] == "supported"
    results = spark.createDataFrame([("o/a", "# x", '{"k":[1]}', None), ("b", "y\n", "{", "c,d"), ("e", None, None, None)], "target string, markdown string, json string, csv string")
    rows = {(r["target"], r["error"]): r["path"] for r in discovery.write_artifacts(results, f"file://{tmp_path}/out").collect()}
    assert set(rows) == {("o/a", None), ("b", "bad-json"), ("e", "nothing-to-write")}
    assert (tmp_path / "out/o/a.md").read_text() == "# x\n" and (tmp_path / "out/o/a.json").read_text() == '{\n  "k": [\n    1\n  ]\n}\n'
    assert {r["target"]: r["error"] for r in discovery.write_artifacts(results, str(tmp_path / "csv"), "csv").collect()} == {"o/a": "csv-missing", "b": None, "e": "csv-missing"}
    assert (tmp_path / "csv/b.csv").read_text() == "c,d\n" and len(list(tmp_path.rglob("*.new"))) == 0
    twice = discovery.write_artifacts(results.unionByName(results), f"file://{tmp_path}/twice")
    (tmp_path / "twice/o/left.md").write_text("not of this run")
    back = discovery.read_artifacts(twice)
    assert sorted((r["path"].rsplit("/twice/")[1], bytes(r["content"])) for r in back.collect()) == [("o/a.json", b'{\n  "k": [\n    1\n  ]\n}\n'), ("o/a.md", b"# x\n")]
    assert "binaryFile" not in back._jdf.queryExecution().toString()  # no listing of all files in the driver
    texts = spark.createDataFrame([(1, "aé😀" * 50), (2, "")], "doc_id long, text string")
    chunks = discovery.chunk_artifacts(texts, max_bytes=10).orderBy("id", "chunk_no").collect()
    assert "".join(r["chunk"] for r in chunks if r["id"] == 1) == "aé😀" * 50 and all(len(r["chunk"].encode()) <= 10 for r in chunks)
    assert [r["eof"] for r in chunks if r["id"] == 2] == [True]


def test_stream_ingest_redoes_nothing(spark, tmp_path):
    source, work = tmp_path / "in", tmp_path / "work"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"k: {i}")

    def extract(rows):
        return rows.select("source", "fingerprint", F.when(F.col("source").endswith("1.txt"), "failed").otherwise("succeeded").alias("status"))

    def run(checkpoint):
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(source))
        jobs.stream_ingest(stream.select("path", "content"), str(work), extract, checkpoint, compact_every=2).trigger(availableNow=True).start().awaitTermination(120)

    def done():
        rows = spark.read.option("basePath", f"{work}/results").parquet(f"{work}/results/run=*/batch=*").groupBy("source").count().collect()
        return {r["source"].rsplit("/", 1)[-1]: r["count"] for r in rows}

    def entries():
        return {r["source"].rsplit("/", 1)[-1]: (r["status"], r["fingerprint"]) for r in jobs.ManifestLog(spark, f"{work}/manifest").entries().collect()}

    run(f"{work}/c1")
    assert done() == {"0.txt": 1, "1.txt": 1, "2.txt": 1}
    last = max((work / "c1/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    before = entries()
    last.unlink()  # the batch was written, its commit was lost: it is repeated
    (work / f"c1/commits/.{last.name}.crc").unlink(missing_ok=True)
    run(f"{work}/c1")
    assert done() == {"0.txt": 1, "1.txt": 1, "2.txt": 1} and entries() == before
    for i in range(3, 9):
        (source / f"{i}.txt").write_text(f"k: {i}")
        run(f"{work}/c1")
    assert done() == {f"{i}.txt": 1 for i in range(9)} and len(entries()) == 9
    assert len(list((work / "manifest").glob("whole-*"))) <= 2 and len(list((work / "manifest/delta").glob("run=*/batch=*"))) <= 5
    run(f"{work}/c2")  # another query sees all files again: only the failed one is tried anew, and nothing is overwritten
    assert done() == {f"{i}.txt": 1 + (i == 1) for i in range(9)}
    (source / "0.txt").write_text("changed")
    run(f"{work}/c3")
    assert done()["0.txt"] == 2 and entries()["0.txt"] != before["0.txt"]


def delta(spark, log, run, number, rows):
    entries = spark.createDataFrame([(d, f, s, [], [], t) for d, f, s, t in rows],
        "source string, fingerprint string, status string, output_files array<string>, owned_files array<string>, updated long")
    log.write(entries, f"{log.folder}/delta/run={run}/batch={number}")


def seen(log, run, number, compact_every=1 << 30):
    return {r["source"]: r["status"] for r in log.before(run, number, compact_every).collect()}


def test_two_queries_share_a_manifest(spark, tmp_path):
    """Compaction by one query between another's write and its commit: the repeat sees what the first attempt saw, and no row is lost."""
    log = jobs.ManifestLog(spark, f"{tmp_path}/m")
    delta(spark, log, "r1", 0, [("a", "1", "succeeded", 1)])
    delta(spark, log, "r1", 1, [("b", "1", "succeeded", 2)])  # written, not committed yet
    for n in range(4):
        delta(spark, log, "r2", n, [(f"x{n}", "1", "succeeded", 3 + n)])
    others = {f"x{n}": "succeeded" for n in range(4)}
    assert seen(log, "r2", 4, compact_every=2) == {"a": "succeeded", "b": "succeeded", **others}
    assert log.versions()[1]["marks"] == {"r1": 1, "r2": 4}
    assert seen(log, "r1", 1) == {"a": "succeeded", **others}  # its own batch isn't part of the version
    delta(spark, log, "r1", 1, [("b", "1", "failed", 9)])
    assert seen(log, "r1", 2) == {"a": "succeeded", "b": "failed", **others}
    for n in range(2, 9):
        delta(spark, log, "r1", n, [(f"y{n}", "1", "succeeded", 10 + n)])
        seen(log, "r1", n + 1, compact_every=2)
    assert {r["source"] for r in log.entries().collect()} == {"a", "b", *others, *(f"y{n}" for n in range(2, 9))}
    assert len(list(tmp_path.glob("m/whole-*"))) <= 2 and len(list(tmp_path.glob("m/delta/run=*/batch=*"))) <= 6
    assert seen(log, "r2", 4) == {r["source"]: r["status"] for r in log.entries().collect()}


def test_of_two_compactions_at_once_one_counts(spark, tmp_path):
    one, two = (jobs.ManifestLog(spark, f"{tmp_path}/m") for _ in range(2))
    for n in range(3):
        delta(spark, one, "r1", n, [(f"a{n}", "1", "succeeded", n)])
    settled = {k: p for k, p in one.deltas().items() if k[1] < 2}
    assert one.put(1, {"whole": None, "marks": {}}, settled) and not two.put(1, {"whole": None, "marks": {}}, settled)
    assert len(list(tmp_path.glob("m/whole-*"))) == 1 and {r["source"] for r in two.entries().collect()} == {"a0", "a1", "a2"}
    (tmp_path / "m/log/2").write_text('{"whole": ')  # a version that is being written doesn't count yet
    assert max(one.versions()) == 1 and len(one.entries().collect()) == 3


def test_sequence_audit(spark):
    rows = [(1, s, d, t) for s, d,
        t in ((0, None, "run.started"), (1, 7, "document.started"), (2, 7, "document.completed"), (2, 8, "document.progress"),
            (6, None, "run.completed"), (7, 9, "document.started"), (9, 9, "document.progress"))]
    got = jobs.sequence_audit(spark.createDataFrame(rows, "run_id long, sequence long, document_id long, type string")).first().asDict()
    assert got == {"run_id": 1, "gaps": 2, "repeats": 1, "events": 7, "unstarted": 1, "unended": 2, "late": 2}


def test_streams_equal_their_batch_form(spark, tmp_path):
    from quire.views import Inputs
    from tests.conftest import SF

    v = Inputs(spark, SF)
    events = v("run_events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = stateful.lifecycle_stream(stream).writeStream.format("memory").queryName("lifecycle").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("lifecycle").where("state <> 'stuck'").groupBy("run_id", "document_id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("sequence"))
    key = lambda r: (r["run_id"], r["document_id"], r["state"], r["sequence"])
    assert {key(r) for r in got.collect()} == {key(r) for r in jobs.document_lifecycle(events).collect()}
    u = v("usage_log").select("job_id", "input_tokens", "output_tokens")
    u.write.parquet(f"{tmp_path}/usage")
    q = (jobs.running_usage(spark.readStream.schema(u.schema).parquet(f"{tmp_path}/usage"), 1000).writeStream.format("memory").queryName("live")
        .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, jobs.running_usage(u, 1000).collect()))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cells_without_marks_pass_by_python(spark, monkeypatch):
    """rows whose texts need no Python aren't sent to a worker, not even as nulls."""
    from pyspark.sql.functions import pandas_udf

    def refuse(text: pd.Series) -> pd.Series:
        if len(text):
            raise ValueError("a row reached Python")
        return text

    from quire.functions import text as texts
    from quire.operators import scoring

    monkeypatch.setattr(texts, "_normal", pandas_udf(refuse, "string"))
    cells = "doc_id long, row_no long, column_name string, value string"
    ref = spark.createDataFrame([(1, 1, "line_total", "10.50"), (1, 1, "quantity", "2"), (2, 1, "quantity", " ")], cells)
    pred = spark.createDataFrame([(1, 1, "Line_total", " 10.50"), (1, 1, "quantity", "3"), (1, 2, "quantity", "")], cells)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r["doc_id"]: r["cell_f1"] for r in scoring.table_cell_scores(docs, ref, pred).collect()} == {1: 0.5, 2: 1.0, 3: 1.0}


def test_normalized_rows_equal_plain_python(spark):
    from quire.functions import markup
    from quire.functions import text as texts

    odd = ["", " ", "_", "~ _", "a_b~c", "__bold__ x", "1. item", "12) item", "a. b) c", "1.5", "x\ty\n\nz", "a _ b", "Ünï  code", "# head", "> quote", "* a", "+ 1", "- b", "a-b",
        "<b>x</b>", "[l](t)", "`c`", "A  B", "\x0bv\x0c", "_1. x", "~\r\n_", " x", "1_. x", "\x1cx\x1c", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string").withColumn("u", F.lit("line_total"))
    got = {r["i"]: (r["n"], r["m"]) for r in texts.with_normalized(rows, {"n": "t", "m": "u"}).collect()}
    assert got == {i: (None if t is None else markup.normal(t), "linetotal") for i, t in enumerate(odd)}
    assert {r["i"]: r["n"] for r in rows.select("i", texts.normalized("t").alias("n")).collect()} == {i: got[i][0] for i in got}


def test_rules_are_judged_where_values_are_read(spark):
    """only failing values meet the documents in a join; documents times rules were sorted twice. Copies of rows count as they did."""
    docs = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "doc_id long")
    fields = spark.createDataFrame([(1, "a", "x1", None), (1, "a", " ", None), (1, "b", "y", None), (1, "b", "z", None), (2, "a", None, ["1", None, "q"]), (2, "c", "k", None), (2, "d", "k", None),
        (9, "a", "q", None), (None, "a", "q", None), (3, "b", "", None), (3, "a", "7", [])], "doc_id long, field string, value string, items array<string>")
    rules = spark.createDataFrame([("a", True, "[0-9]"), ("b", False, "*"), ("c", True, None)], "field string, required boolean, pattern string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = presets.validate_rules(docs, fields, rules)
        assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        rows = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = [(1, "a", "required", None)] * 2 + [(1, "c", "required", None)] * 2 + [(1, "b", "invalid-pattern", None), (2, "a", "pattern", "q"), (3, "a", "required", None), (3, "c", "required", None),
        (None, "a", "required", None), (None, "c", "required", None)]
    assert rows == sorted(want, key=str)


def test_more_rules_than_bits_of_a_word(spark):
    rules = spark.createDataFrame([(f"f{i}", True, None) for i in range(130)], "field string, required boolean, pattern string")
    fields = spark.createDataFrame([(1, f"f{i}", "v") for i in range(130) if i != 77], "doc_id long, field string, value string")
    assert [tuple(r) for r in presets.validate_rules(spark.createDataFrame([(1,)], "doc_id long"), fields, rules).collect()] == [(1, "f77", "required", None)]
