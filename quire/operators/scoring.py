"""Scores of extracted text, fields and tables against references, and of whole evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.distance import all_close, found_within, normal_edits, plain_edits, starts_before, word_edits
from quire.functions.text import normalized, unit_test_text, unit_test_texts, with_normalized, words
from quire.operators.structure import cell_surroundings, gathered


def _by_document(rows: DataFrame) -> DataFrame:
    """Rows dealt by document: what follows takes far longer than reading them, joins and groups by document, and so shuffles no more."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "doc_id")


def _edited(pairs: DataFrame) -> DataFrame:
    """(doc_id, edits and lengths) of each pair; those that a query doesn't show aren't worked out."""
    kinds = {"e": plain_edits, "ne": normal_edits, "we": word_edits}
    return _by_document(pairs).select("doc_id", *[f("reference", "prediction").alias(k) for k, f in kinds.items()]).select("doc_id", *[f"{k}.*" for k in kinds])


def _rate(edits: str, length: str, other: str) -> Column:
    """Edits by length; an empty reference scores 0 if the prediction is empty too, else 1."""
    return F.when(F.col(length) == 0, F.when(F.col(other) == 0, 0.0).otherwise(1.0)).otherwise(F.col(edits) / F.col(length))


def text_error_rates(pairs: DataFrame) -> DataFrame:
    """Character error rate (of the plain texts, and normalized), similarity and word error rate of (doc_id, reference, prediction).

    The prediction is display Markdown, null is empty. Distances count code points, lengths UTF-16 units."""
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("nd") / F.greatest("n_nr", "n_np", F.lit(1))))
    return _edited(pairs).select("doc_id", _rate("d", "n_r", "n_p").alias("cer"), _rate("nd", "n_nr", "n_np").alias("normalized_cer"),
        similarity.alias("similarity"), _rate("wd", "wr", "wp").alias("wer"))


def corpus_error_rates(pairs: DataFrame) -> DataFrame:
    """One row for all pairs: documents, and the rates of the corpus, all edits by all lengths of the references."""
    total = _edited(pairs).groupBy().agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("d", "nd", "wd", "n_r", "n_p", "n_nr", "n_np", "wr", "wp")])
    return total.select("documents", F.col("d").alias("edits"), F.col("n_r").alias("chars"), _rate("d", "n_r", "n_p").alias("cer"),
        _rate("nd", "n_nr", "n_np").alias("normalized_cer"), _rate("wd", "wr", "wp").alias("wer"))


def token_overlap(pairs: DataFrame) -> DataFrame:
    """(doc_id, coverage, unsupported): shares of the reference's words found, and of the prediction's not in it, as multisets. Words are what spaces
    part in normalized text of any script."""
    sides = _by_document(pairs).select("doc_id", normalized("reference").alias("r"), normalized("prediction").alias("p"))
    side = lambda c, r: F.transform(F.coalesce(words(F.col(c)), F.array().cast("array<string>")), lambda x: F.struct(x.alias("token"), F.lit(r).alias("r"), F.lit(1 - r).alias("p")))
    token = F.explode(F.concat(side("r", 1), side("p", 0)))
    both = sides.select("doc_id", token.alias("t")).groupBy("doc_id", "t.token").agg(F.sum("t.r").alias("r"), F.sum("t.p").alias("p"))
    g = both.groupBy("doc_id").agg(F.sum("r").alias("nr"), F.sum("p").alias("np"), F.sum(F.least("r", "p")).alias("hit"))
    rows = pairs.select("doc_id").join(g, "doc_id", "left").na.fill(0)
    return rows.select("doc_id", F.when(F.col("nr") == 0, 1.0).otherwise(F.col("hit") / F.col("nr")).alias("coverage"),
        F.when(F.col("np") == 0, 0.0).otherwise((F.col("np") - F.col("hit")) / F.col("np")).alias("unsupported"))


def _ratio(top: Column, bottom: Column, empty: Column | float) -> Column:
    return F.when(bottom == 0, empty).otherwise(top / bottom)


def matched_fields(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, field, tp, fp, fn) over non-empty normalized values; a wrong value is both fp and fn."""
    clean = lambda d, n: d.select("doc_id", "field", normalized("value").alias(n)).where(F.col(n) != "")
    both = clean(reference, "r").join(clean(predicted, "p"), ["doc_id", "field"], "full_outer")
    hit = F.col("r").eqNullSafe(F.col("p")).cast("long")
    return both.select("doc_id", "field", hit.alias("tp"), (F.col("p").isNotNull().cast("long") - hit).alias("fp"), (F.col("r").isNotNull().cast("long") - hit).alias("fn"))


def field_scores(reference: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """Tp, fp, fn, precision, recall and F1 by ``keys`` (doc_id, field, or none for one row)."""
    g = matched_fields(reference, predicted).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(0.0))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    s = g.withColumn("precision", precision).withColumn("recall", recall)
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def critical_match(docs: DataFrame, reference: DataFrame, predicted: DataFrame, critical: list[str]) -> DataFrame:
    """The share of the listed fields that are equal on both sides; 1 if none is listed."""
    if not critical:
        return docs.select("doc_id", F.lit(1.0).alias("critical_match"))
    hits = matched_fields(reference, predicted).where(F.col("field").isin(*critical) & (F.col("tp") == 1)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(hits, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) / len(critical)).alias("critical_match"))


def table_cell_scores(docs: DataFrame, reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """F1 over the multiset of (column, value) of each document; empty cells drop out, row order doesn't matter."""
    def cells(d: DataFrame, r: int) -> DataFrame:
        # taken out of an array, so that no filter moves below what a cell is worked out from and repeats it
        cell = d.select("doc_id", F.struct(F.col("column_name").alias("c"), F.col("value").alias("v")).alias("cell"))
        return cell.select("doc_id", F.explode(F.when(F.trim("cell.v") != "", F.array("cell"))).alias("cell")).select("doc_id", "cell.*", F.lit(r).alias("r"), F.lit(1 - r).alias("p"))

    filled = lambda n: F.sum(F.when(F.col("v") != "", F.col(n)).otherwise(0)).alias(n)  # noqa: E731  a filter would work texts out twice
    both = with_normalized(cells(reference, 1).unionByName(cells(predicted, 0)), {"c": "c", "v": "v"}).groupBy("doc_id", "c", "v").agg(filled("r"), filled("p"))
    g = both.groupBy("doc_id").agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum(F.least("r", "p")).alias("tp"))
    return (docs.select("doc_id").join(g, "doc_id", "left").na.fill(0)
        .select("doc_id", F.when(F.col("r") + F.col("p") == 0, 1.0).otherwise(2 * F.col("tp") / (F.col("r") + F.col("p"))).alias("cell_f1")))


def _cut() -> Column:
    """``output``, or its head, tail, or head and tail together; 0 is no limit."""
    head, tail = F.coalesce("first_n", F.lit(0)) > 0, F.coalesce("last_n", F.lit(0)) > 0
    first, last = F.expr("left(output, first_n)"), F.expr("right(output, last_n)")
    return F.when(head & tail, F.concat(first, last)).when(head, first).when(tail, last).otherwise(F.col("output"))


def _most(tests: DataFrame) -> Column:
    return F.coalesce("max_diffs", F.lit(0)) if "max_diffs" in tests.columns else F.lit(0)


def presence_tests(tests: DataFrame, outputs: DataFrame) -> DataFrame:
    """(test_id, doc_id, passed) for present and absent tests, on normalized texts. What ``contains`` finds is found; only tests with ``max_diffs`` of
    which that isn't so are looked at further: around the places where one of max_diffs + 1 pieces of the needle stands."""
    rows = tests.where(F.col("type").isin("present", "absent")).join(_by_document(outputs.select("doc_id", F.col("text").alias("output"))), "doc_id")
    cased = lambda c: F.when(F.coalesce("case_sensitive", F.lit(True)), F.col(c)).otherwise(F.lower(c))
    rows = rows.withColumns({"output": unit_test_text("output"), "needle": unit_test_text("text")}).withColumns({"output": cased("output"), "needle": cased("needle")})
    rows = rows.select("test_id", "doc_id", "type", "needle", _cut().alias("hay"), _most(tests).alias("k"))
    rows = rows.withColumn("exact", F.contains("hay", "needle"))
    near = ~F.col("exact") & (F.col("k") > 0)
    found = rows.withColumn("found", F.when(near, found_within(F.when(near, F.col("needle")), F.when(near, F.col("hay")), F.when(near, F.col("k")).otherwise(0))).otherwise(F.col("exact")))
    return found.select("test_id", "doc_id", F.when(F.col("type") == "present", F.col("found")).otherwise(~F.col("found")).alias("passed"))


def order_tests(tests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Passes if the first start of ``before`` lies before the last start of ``after`` in the normalized text, both within ``max_diffs``
    edits (0 where there is no such column). Texts are normalized once for both kinds; exact tests reach Python as nulls."""
    rows = tests.where(F.col("type") == "order").join(_by_document(outputs.select("doc_id", F.col("text").alias("output"))), "doc_id")
    own = F.struct(*[unit_test_text(c).alias(c) for c in ("before", "after", "output")], _most(tests).alias("k"))
    # taken out of an array, so that texts aren't normalized again wherever they are looked at
    rows = rows.select("test_id", "doc_id", own.alias("own")).select("test_id", "doc_id", F.explode(F.array("own")).alias("own")).select("test_id", "doc_id", "own.*")
    plain = (F.col("k") == 0) & (F.length("before") > 0) & (F.length("after") > 0)
    first = F.call_function("locate", F.col("before"), F.col("output"))
    back = F.call_function("locate", F.reverse("after"), F.reverse("output"))
    last = F.when(back > 0, F.length("output") - back - F.length("after") + 2).otherwise(0)
    near = ~F.coalesce(plain, F.lit(False))
    some = lambda c: F.when(near, F.col(c))
    closer = starts_before(some("before"), some("after"), some("output"), some("k"))
    return rows.select("test_id", "doc_id", F.when(near, closer).otherwise((first > 0) & (last > 0) & (first < last)).alias("passed"))


_AROUND = ("up", "down", "left", "right", "top_heading", "left_heading")


def _normal_tables(tables: DataFrame) -> DataFrame:
    texts = tables.withColumn("texts", unit_test_texts(F.transform("cells", lambda c: c["text"])))
    return texts.withColumn("cells", F.transform("cells", lambda c, i: c.withField("text", F.get("texts", i)))).drop("texts")


def table_tests(tests: DataFrame, cells: DataFrame, neighbors: DataFrame | None = None, headings: DataFrame | None = None) -> DataFrame:
    """Passes if some cell matches, and with it on each stated side one of its neighbours or headings: normalized texts that are equal where
    ``max_diffs`` is 0, else of an indel ratio of 1 - max_diffs / length, 0.5 at least. Cells with spans have several neighbours on a side. Without
    ``neighbors`` and ``headings`` both are worked out from ``cells``, which can be tables (:func:`quire.operators.structure.markdown_tables`).

    Tests meet the cells of their document once and are judged inside the row; only tests with edits whose lengths leave it open reach Python."""
    cell = ["doc_id", "table_no", "cell_id"]
    if neighbors is None:
        places = cell_surroundings(_normal_tables(gathered(cells))).select("doc_id", F.col("text").alias("got"), *_AROUND)
    else:
        both = neighbors.join(headings.select(*cell, *_AROUND[4:]), cell, "left")
        lists = [F.coalesce(k, F.array().cast("array<string>")) for k in _AROUND]
        all_ = both.select("doc_id", unit_test_text("text").alias("got"), unit_test_texts(F.flatten(F.array(*lists))).alias("all"), *[F.size(x).alias(k) for k, x in zip(_AROUND, lists)])
        begin = lambda i: sum((F.col(k) for k in _AROUND[:i]), F.lit(1))
        places = all_.select("doc_id", "got", *[F.slice("all", begin(i), F.col(k)).alias(k) for i, k in enumerate(_AROUND)])
    rows = tests.where(F.col("type") == "table").select("test_id", "doc_id", unit_test_text("cell").alias("want"), *[unit_test_text(k).alias(f"want_{k}") for k in _AROUND], _most(tests).alias("k"))
    stated = lambda k: F.coalesce(F.col(f"want_{k}"), F.lit("")) != ""
    want, got, k = F.coalesce("want", F.lit("")), F.col("got"), F.col("k")

    def may(want: Column, got: Column) -> Column:
        """Whether texts of these lengths can be alike enough."""
        n, m = F.length(want), F.length(got)
        return F.when(n + m == 0, True).otherwise(F.lit(2.0) * F.least(n, m) / (n + m) >= F.greatest(F.lit(0.5), 1 - k / F.greatest(n, F.lit(1))))

    equal, close = F.col("want") == got, (k > 0) & got.isNotNull() & may(want, got)
    def some(side: str) -> Column:
        return F.coalesce(F.exists(side, lambda x: may(F.col(f"want_{side}"), x)), F.lit(False))

    for side in _AROUND:
        equal &= ~stated(side) | F.coalesce(F.array_contains(side, F.col(f"want_{side}")), F.lit(False))
        close &= ~stated(side) | some(side)
    pairs = F.array(F.struct(want.alias("want"), F.array("got").alias("got")), *[F.when(stated(s), F.struct(F.col(f"want_{s}").alias("want"), F.col(s).alias("got"))) for s in _AROUND])
    met = rows.join(places, "doc_id").withColumn("equal", F.coalesce(equal, F.lit(False))).where(F.col("equal") | F.coalesce(close, F.lit(False)))
    # no filter looks at what Python says: it would be merged with the one above and see all rows
    closer = F.coalesce(all_close(F.when(~F.col("equal"), F.filter(pairs, lambda p: p.isNotNull())), "k"), F.lit(False))
    found = met.select("test_id", "doc_id", (F.col("equal") | closer).alias("passed"), F.lit(0).alias("n"))
    each = found.unionByName(rows.select("test_id", "doc_id", F.lit(False).alias("passed"), F.lit(1).alias("n"))).groupBy("test_id", "doc_id").agg(F.bool_or("passed").alias("passed"), F.sum("n").cast("int").alias("n"))
    return each.select("test_id", "doc_id", F.explode(F.array_repeat("passed", F.col("n"))).alias("passed"))


def unit_pass_rate(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Passed / total of each document, 0 without tests."""
    g = results.groupBy("doc_id").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    return docs.join(g, "doc_id", "left").select("doc_id", F.coalesce("rate", F.lit(0.0)).alias("unit_pass_rate"))


def run_assertions(assertions: DataFrame, outputs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(case_id, passed, failed): eight kinds of checks; a missing metric or a runtime error fails.

    ``assertions``: case_id, type, value, path, expected, min, max, metric. ``outputs``: case_id, text, json, error, table_rows.
    ``metrics``: case_id, metric, score."""
    m = metrics.withColumnsRenamed({"metric": "__m", "case_id": "__c"})
    rows = assertions.join(outputs, "case_id", "left").join(m, (F.col("case_id") == F.col("__c")) & (F.col("metric") == F.col("__m")), "left")
    at = F.expr("try_variant_get(try_parse_json(json), concat('$.', path), 'string')")
    kind = F.col("type")
    ok = (F.when(F.col("error").isNotNull(), False).when(kind == "contains", F.contains("text", "value"))
        .when(kind == "not_contains", ~F.contains("text", "value")).when(kind == "json_field_equals", at == F.col("expected"))
        .when(kind == "json_field_exists", F.coalesce(at, F.lit("")) != "")
        .when(kind == "json_field_number_min",
            F.expr("try_cast(try_variant_get(try_parse_json(json), concat('$.', path), 'string') as double)") >= F.col("min"))
        .when(kind == "table_min_rows", F.coalesce("table_rows", F.lit(0)) >= F.col("min")).when(kind == "metric_min", F.col("score") >= F.col("min"))
        .when(kind == "metric_max", F.col("score") <= F.col("max")))
    done = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return done.groupBy("case_id").agg(F.bool_and("ok").alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("type")))), ",").alias("failed"))


def weighted_score(cases: DataFrame, *keys: str) -> DataFrame:
    """Passing weight over weight, the pass rate where all weights are zero; a missing weight is 1."""
    w = F.coalesce("weight", F.lit(1)).cast("double")
    g = cases.groupBy(*keys).agg(F.sum(F.when(F.col("passed"), w).otherwise(0.0)).alias("won"), F.sum(w).alias("all"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
    return g.select(*keys, F.when(F.col("all") == 0, F.col("pass_rate")).otherwise(F.col("won") / F.col("all")).alias("score"), "pass_rate")


def metric_statistics(metrics: DataFrame) -> DataFrame:
    """Mean, extremes, population deviation and samples of each metric."""
    s = F.col("score")
    return metrics.groupBy("metric").agg(F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_pop(s).alias("std_dev"), F.count(s).alias("samples"))


def breakdowns(cases: DataFrame) -> DataFrame:
    """Cases, passes, pass rate, mean metric, mean duration and tokens and total cost over all, by mode, and by tag (a case counts under each of its ``tags``)."""
    figures = [F.count("*").alias("cases"), F.count_if("passed").alias("passes"), F.avg(F.col("passed").cast("int")).alias("pass_rate"),
        F.avg("metric").alias("mean_metric"), F.avg("duration_ms").alias("mean_duration_ms"), F.avg("tokens").alias("mean_tokens"),
        F.sum("cost").alias("total_cost")]
    by_mode = cases.groupingSets([["mode"], []], "mode").agg(*figures, F.grouping_id().alias("level"))
    by_tag = cases.withColumn("tag", F.explode(F.array_distinct("tags"))).groupBy("tag").agg(*figures)
    shown = ["cases", "passes", "pass_rate", "mean_metric", "mean_duration_ms", "mean_tokens", "total_cost"]
    one = by_mode.select(F.when(F.col("level") == 0, "mode").otherwise("all").alias("kind"), F.col("mode").alias("name"), *shown)
    return one.unionByName(by_tag.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), *shown))


def suite_gate(cases: DataFrame, min_score: float = 0.75) -> DataFrame:
    """One row: the weighted score and whether the suite fails."""
    failing = cases.agg(F.count_if(~F.col("passed")).alias("failing"))
    return weighted_score(cases).join(F.broadcast(failing), F.lit(True)).select("score", "failing", ((F.col("failing") > 0) | (F.col("score") < min_score)).alias("failed"))


def failure_report(cases: DataFrame) -> DataFrame:
    """Failing cases with the number of failed repeats and a message."""
    g = cases.where("not passed").groupBy("case_id").agg(F.count("*").alias("failures"), F.min("repeat_no").alias("first"))
    return g.select("case_id", "failures", F.format_string("case %d failed %d times, first in repeat %d", "case_id", "failures", "first").alias("message"))


def provider_matrix(cases: DataFrame, min_score: float = 0.75) -> DataFrame:
    """A row for each route: cases, pass rate, score, status and its rank by mean metric, the best first."""
    g = cases.groupBy("route").agg(F.count("*").alias("cases"), F.avg("metric").alias("mean_metric")).join(weighted_score(cases, "route"), "route")
    return g.select("route", "cases", "pass_rate", "score", "mean_metric",
        F.when(F.col("score") >= min_score, "passed").otherwise("failed").alias("status"),
        F.dense_rank().over(W.orderBy(F.desc("mean_metric"))).alias("rank"))


def repeat_stability(cases: DataFrame) -> DataFrame:
    """The spread of the metric over the repeats of a case, and whether it flips between pass and fail."""
    return cases.groupBy("case_id").agg(F.count("*").alias("repeats"), F.stddev_pop("metric").alias("std_dev"), (F.count_distinct("passed") > 1).alias("flips"))


def sample_by_hash(rows: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows of each group whose sha256 of seed and key is smallest: the same sample on any machine."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("__h", h).withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy("__h"))).where(F.col("__n") <= n).drop("__h", "__n")


def lines_from_words(receipts: DataFrame) -> DataFrame:
    """(doc_id, text): words to lines, lines to text, blank ones dropped. ``receipts``: doc_id, lines (array of arrays of words)."""
    lines = F.filter(F.transform("lines", lambda ws: F.trim(F.array_join(F.filter(ws, lambda w: F.trim(w) != ""), " "))), lambda x: x != "")
    return receipts.select("doc_id", F.array_join(lines, "\n").alias("text"))


def text_from_blocks(layouts: DataFrame) -> DataFrame:
    """(doc_id, text): blocks in order (no order: last), ignored ones dropped, the first filled of text, latex and stripped html."""
    shown = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (F.col("b.text"), F.col("b.latex"), F.regexp_replace("b.html", "<[^>]+>", " "))])
    rows = layouts.select("doc_id", F.posexplode("blocks").alias("i", "b")).where(~F.coalesce("b.ignore", F.lit(False)))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(shown.isNotNull(),
                    F.struct(F.col("b.order").isNull().alias("none"), F.col("b.order").alias("o"), "i", shown.alias("s"))))).alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text"))


def select_unit_tests(tests: DataFrame, min_tests: int = 3, n: int = 5, seed: str = "seed", types: tuple[str, ...] = ("present", "absent", "order", "table")) -> DataFrame:
    """Documents with ``min_tests`` or more verified tests of page 1, of which ``n`` by hash in each category."""
    ok = tests.where(F.col("checked") & F.col("type").isin(*types) & (F.col("page") == 1))
    docs = ok.groupBy("category", "doc_id").agg(F.count("*").alias("tests")).where(F.col("tests") >= min_tests)
    return sample_by_hash(docs, "category", "doc_id", seed, n)


#: fixed values: names that a case may use
MODES = ("simple", "template", "agentic")
SUITES = ("canary", "full", "benchmark")
METRICS = ("cer", "normalized_cer", "wer", "normalized_edit_similarity", "text_coverage", "unsupported_text_rate", "field_precision", "field_recall",
    "field_f1", "critical_field_exact_match", "table_cell_f1", "unit_test_pass_rate")


def check_cases(cases: DataFrame, suite: str | None = None) -> DataFrame:
    """(case_id, issue): duplicate or blank ids, unknown modes, suites and metrics, templates without a preset, no assertions, iterations below 1,
    thresholds outside 0..1. ``cases``: case_id, mode, preset_id, suites (null: the usual ones), metrics (those its assertions name), assertions (how many),
    max_iterations, threshold. With ``suite`` only its cases are looked at."""
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    some = cases.where(F.array_contains(F.coalesce("suites", F.array(*map(F.lit, ("canary", "full")))), suite)) if suite else cases
    twice = some.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate-id").alias("issue"))
    agentic = F.col("mode") == "agentic"
    tests = {
        "no-id": F.trim(F.coalesce(F.col("case_id").cast("string"), F.lit(""))) == "",
        "bad-mode": ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)),
        "no-preset": (F.col("mode") == "template") & (F.trim(F.coalesce("preset_id", F.lit(""))) == ""),
        "no-assertions": F.coalesce("assertions", F.lit(0)) == 0,
        "bad-suite": F.exists(lists("suites"), lambda s: ~F.coalesce(s.isin(*SUITES), F.lit(False))),
        "unknown-metric": F.exists(lists("metrics"), lambda m: ~F.coalesce(m.isin(*METRICS), F.lit(False))),
        "bad-iterations": agentic & (F.col("max_iterations") < 1),
        "bad-threshold": agentic & ((F.col("threshold") < 0) | (F.col("threshold") > 1)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return twice.unionByName(some.select("case_id", F.explode(found).alias("issue")))
