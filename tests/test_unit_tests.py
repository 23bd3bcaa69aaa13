"""Presence, order and table tests with edits, both limits, and Markdown on either side."""

from quire.operators import scoring
from quire.operators import structure as m


def passed(df):
    return {r["test_id"]: r["passed"] for r in df.collect()}


def test_presence_joins_head_and_tail(spark):
    out = spark.createDataFrame([(1, "alpha **beta**\n\nmiddle “word” omega")], "doc_id long, text string")
    rows = [(1, "omega", 0, 5, 5), (2, "alpha", 0, 5, 5), (3, "middle", 0, 5, 5), (4, "omega", 0, 5, None), (5, "alpha", 0, None, 5),
        (6, 'beta middle "word"', 0, None, None), (7, "__alpha__ beta", 0, 0, 0), (8, "omagа", 2, 5, 5)]
    tests = spark.createDataFrame([(i, 1, "present", t, k, True, a, z) for i, t, k, a, z in rows],
        "test_id long, doc_id long, type string, text string, max_diffs int, case_sensitive boolean, first_n int, last_n int")
    assert passed(scoring.presence_tests(tests, out)) == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True, 8: True}


def test_order_with_edits(spark):
    out = spark.createDataFrame([(1, "first **line** of text then the second line")], "doc_id long, text string")
    rows = [(1, "frst line", "secnd", 1), (2, "frst line", "secnd", 0), (3, "secnd", "frst line", 1), (4, "first line", "second", 0),
        (5, "line", "line", 0), (6, "text", "nowhere", 2), (7, "first  line", "_second_", 0)]
    tests = spark.createDataFrame([(i, 1, "order", b, a, k) for i, b, a, k in rows], "test_id long, doc_id long, type string, before string, after string, max_diffs int")
    assert passed(scoring.order_tests(tests, out)) == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}


def test_table_tests_choose_by_row(spark):
    cells = m.table_cells(spark.createDataFrame([(1, "| item | price |\n| --- | --- |\n| **apple** | 100 |\n| pears | 250 |")], "doc_id long, text string"))
    rows = [(1, "appel", None, 2), (2, "appel", None, 0), (3, "apple", "100", 0), (4, "appl", "1OO", 1), (5, "apple", "250", 0), (6, "peers", "25O", 1), (7, "apple", "", 0)]
    tests = spark.createDataFrame([(i, 1, "table", c, None, None, None, r, None, None, k) for i, c, r, k in rows],
        "test_id long, doc_id long, type string, cell string, up string, down string, left string, right string, top_heading string, left_heading "
            "string, max_diffs int")
    assert passed(scoring.table_tests(tests, cells, m.cell_neighbors(cells), m.cell_headings(cells))) == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_spans_have_several_neighbours(spark):
    html = "<table><thead><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>c</td><td>d</td></tr></thead><tr><td rowspan=2>x</td><td colspan=2>wide</td></tr><tr><td>1</td><td>2</td></tr></table>"
    cells = m.html_table_cells(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    near = {r["text"]: r for r in m.cell_neighbors(cells).collect()}
    assert (near["A"]["right"], near["A"]["down"], near["B"]["down"], near["wide"]["up"], near["x"]["right"], near["2"]["up"]) == (["B", "c"], ["x"], ["c", "d"], ["c", "d"], ["wide", "1"], ["wide"])
    heads = {r["text"]: r for r in m.cell_headings(cells).collect()}
    assert heads["1"]["top_heading"] == ["B", "c", "d"] and heads["1"]["left_heading"] == ["x"] and heads["d"]["left_heading"] == ["A", "c"] and heads["A"]["top_heading"] == []
    rows = [(1, "1", "wide", "d"), (2, "1", "2", None), (3, "wide", "d", "B"), (4, "x", "A", "A"), (5, "2", None, "A")]
    tests = spark.createDataFrame([(i, 1, "table", c, u, None, None, None, t, None, 0) for i, c, u, t in rows],
        "test_id long, doc_id long, type string, cell string, up string, down string, left string, right string, top_heading string, left_heading "
            "string, max_diffs int")
    assert passed(scoring.table_tests(tests, cells, m.cell_neighbors(cells), m.cell_headings(cells))) == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_order_with_edits_reads_no_further_than_it_must(spark, monkeypatch):
    """starts are looked for from their side, and what lies beyond the first one found isn't worked out."""
    import pandas as pd

    from quire.functions import distance

    read, own = [], distance._last_row
    monkeypatch.setattr(distance, "_last_row", lambda a, b, free_start=False: read.append(len(b)) or own(a, b, free_start))
    text = "head line " + "he li e ta l " * 10_000 + "tail line"
    said = distance.starts_before.func(*map(pd.Series, (["hesd"], ["tial line"], [text], [2])))
    assert said.tolist() == [True] and sum(read) < 5000


def test_first_and_last_start_equal_all_starts():
    import random

    from quire.functions import distance

    random.seed(7)
    for _ in range(1500):
        letters, n, k = random.choice(["ab", "abc d"]), random.choice([0, 1, 5, 40, 600]), random.randint(0, 3)
        text, needle = ("".join(random.choice(letters) for _ in range(m)) for m in (n, random.randint(0, 7)))
        starts = distance._starts(needle, text, k)
        assert (distance._start(needle, text, k, False), distance._start(needle, text, k, True)) == ((starts.min(), starts.max()) if len(starts) else (None, None))


def test_unit_texts_of_fancy_typography():
    import random
    import unicodedata

    from quire.functions import markup

    random.seed(7)
    for _ in range(1500):
        text = "".join(random.choice([*map(chr, markup.UNIT_PLAIN), "é", "é", "a", " ", "μ"]) for _ in range(20))
        assert markup.unit(text) == unicodedata.normalize("NFC", markup._RUN.sub(" ", text)).translate(markup.UNIT_PLAIN)
