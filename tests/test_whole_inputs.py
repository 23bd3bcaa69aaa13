"""The derived inputs hold the whole of the tables they come from."""

import random
import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import distance, markup
from quire.operators import scoring
from quire.views import Inputs
from tests.conftest import SF


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def damaged(rng, a, alphabet, edits):
    b = list(a)
    for _ in range(edits):
        at = rng.randrange(len(b) + 1)
        b[at : at + rng.randrange(2)] = [rng.choice(alphabet)] * rng.randrange(2)
    return "".join(b)


def test_distances_equal_brute_force():
    """1000 random pairs through whatever way edits() chooses, and each way on its own."""
    rng = random.Random(3)
    for i in range(1000):
        alphabet = ("ab", "abcdefgh é", "日本語ab")[i % 3]
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 20, 60, 90, 300] if i % 10 else [700])))
        b = damaged(rng, a, alphabet, rng.choice([0, 1, 3, 10, 40]))
        want = plain_edit(a, b)
        assert distance.edits(a, b) == want == distance.edits(b, a)
        if a and b:
            assert distance._bits(a, b) == want and distance._few(a, b, 20)[0] == (want if want <= 20 else None)
        for k in (1, 5, 17, 60, 200):
            if b and k < len(a) and abs(len(a) - len(b)) <= k:
                near = distance._banded(a, b, k)
                assert near == want if want <= k else near > k
    a = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    assert distance.edits(a, a[:9000] + "xx" + a[9000:20_000] + a[20_010:]) == 12
    assert distance.edits("ab c".split(), "x ab c".split()) == 1


def test_seeded_matches_equal_full_tables():
    rng = random.Random(4)
    for i in range(400):
        alphabet = ("ab", "abcdé")[i % 2]
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 200])))
        at = rng.randrange(len(text) + 1)
        needle = damaged(rng, text[at : at + rng.choice([0, 2, 5, 12])], alphabet, 1) if i % 3 else "".join(rng.choice(alphabet) for _ in range(4))
        for k in (0, 1, 2, 3):
            full = [e for e, d in enumerate(distance._last_row(needle, text, True).tolist()) if d <= k]
            assert distance._ends(needle, text, k).tolist() == full
            back = {len(text) - e for e, d in enumerate(distance._last_row(needle[::-1], text[::-1], True).tolist()) if e and d <= k}
            assert set(distance._starts(needle, text, k).tolist()) == back


def test_markup_is_taken_away():
    plain = {"#\n\n": "", "# Title #": "Title #", "#tag": "#tag", "####### seven": "####### seven", "    # code": "# code", "a\n\n# b": "a\nb",
        "- x\n* y\n+ z\n12) w\n3. v": "x\ny\nz\nw\nv", "-x\n1.y": "-x\n1.y", "> q\n  >r": "q\nr", "# - > all": "all",
        "```py\ncode()\n```\nend": "code()\nend", "![](u) ![p](v) [l](w) [](x)": "p l [](x)", "[a [b](c)": "a [b", "[a] (b)": "[a] (b)",
        "x<b>y</b><>z": "x y <>z", "a < b": "a < b", "**b** _i_ ~~s~~ `c`": "b i s c", "a\r\nb\rc": "a\nb\nc", "\u3000x\ufeff": "x", "": ""}
    assert {k: markup.plain(k) for k in plain} == plain
    normal = {"\u201cCaf\u0065\u0301\u201d \u2014 \ufb01ve": '"caf\u00e9" - five', "A\n\n B\u00a0C": "a b c"}
    assert {k: markup.normal(k) for k in normal} == normal
    unit = {"**a** and __b__": "a and b", "*a*_b_ ***c***": "ab c", "**a\nb**": "a b", "x *a\nb* y": "x *a b* y",
        "x<br/>y<br>z <b>w</b><i>v</i>": "x y z wv", "a * b": "a * b", "2*3*4": "234", "\u201eq\u201d \u2212 \u00b5": '"q" - \u03bc'}
    assert {k: markup.unit(k) for k in unit} == unit


def test_text_pairs_are_whole(spark):
    pairs = {r["doc_id"]: r for r in Inputs(spark, SF)("text_pairs").collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert set(pairs) == set(texts)
    assert all(pairs[d]["reference"] == t for d, t in texts.items())
    assert max(len(r["prediction"]) for r in pairs.values()) > 10_000 and {r["doc_id"]
            for r in scoring.text_error_rates(Inputs(spark, SF)("text_pairs")).where("cer is not null and wer is not null").collect()} == set(texts)


def test_scores_of_text_pairs_equal_brute_force(spark):
    v = Inputs(spark, SF)
    some = v("text_pairs").where("length(reference) between 250 and 1200").orderBy("doc_id").limit(12)
    rows = {r["doc_id"]: r for r in some.collect()}
    assert len(rows) == 12
    assert any(not r["reference"].isascii() for r in rows.values())
    for r in scoring.text_error_rates(some).collect():
        a, b = rows[r["doc_id"]]["reference"].strip(), markup.plain(rows[r["doc_id"]]["prediction"])
        assert r["cer"] == pytest.approx(plain_edit(a, b) / len(a))
        a, b = (" ".join(t.lower().split()) for t in (a.replace("*", ""), b))
        assert r["normalized_cer"] == pytest.approx(plain_edit(a, b) / len(a)) and r["similarity"] == pytest.approx(1 - plain_edit(a, b) / max(len(a), len(b)))
        assert r["wer"] == pytest.approx(plain_edit(a.split(), b.split()) / len(a.split()))
    tests = some.selectExpr("doc_id AS test_id", "doc_id", "'present' AS type", "concat('q', substr(reference, 201, 12)) AS text", "1 AS max_diffs",
        "true AS case_sensitive", "CAST(NULL AS INT) AS first_n", "CAST(NULL AS INT) AS last_n")
    assert all(r["passed"] for r in scoring.presence_tests(tests, some.selectExpr("doc_id", "reference AS text")).collect())


def test_jobs_and_traces_read_whole_texts(spark):
    from quire.plans import jobs

    v, longest = Inputs(spark, SF), f"SELECT max(length({{}})) FROM '{SF}/{{}}.parquet'"
    text = duckdb.sql(longest.format("text", "documents")).fetchall()[0][0]
    most = lambda df, c: df.selectExpr(f"max(length({c}))").first()[0]
    assert most(v.sql(jobs._SECRETS), "text") > text
    assert most(v.sql(jobs._RESPONSES.replace("{g}", "")).where("doc_id % 6 = 5"), "text") == duckdb.sql(longest.format("text", "documents") + " WHERE doc_id % 6 = 5").fetchall()[0][0]
    assert most(v("steps"), "content") == duckdb.sql(longest.format("text", "conversations")).fetchall()[0][0]


def test_markdown_documents_hold_all_lines(spark):
    docs = Inputs(spark, SF)("md_docs").selectExpr("count(*)", "sum(length(text) - length(replace(text, chr(10), '')) - 3)").first()
    assert tuple(docs) == duckdb.sql(f"SELECT count(DISTINCT l_orderkey), count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0]


def test_batches_of_long_texts_are_bounded(spark):
    """A registered query leaves Arrow batches of a few MB, however long its texts; a setting of the user's own stays."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    from quire import plans

    @arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    session = spark.newSession()
    plans.queries()["e06_presence_with_edits"](session, "/root/testdata/sf0.001")
    texts = session.range(5000).repartition(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert texts.select(F.max(size("text"))).first()[0] < 10 << 20
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    plans.queries()["e06_presence_with_edits"](session, "/root/testdata/sf0.001")
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_distances_of_many_pairs_follow_their_edits():
    """Waves, narrow and wide, against bits; damage that goes one way takes less than a band that just holds the distance."""
    rng, words = random.Random(6), "the other father went there with her brother under water etc. été 日本".split()
    texts = [" ".join(rng.choices(words, k=rng.choice([40, 300, 900]))) for _ in range(60)]
    pairs = [(t, t.replace("th", "tn").replace("er ", " ") + " the end") for t in texts]
    pairs += [(t, damaged(rng, t, "abc é", len(t) // rng.choice([5, 15, 50]))) for t in texts]
    pairs += [(b, a) for a, b in pairs[::7]] + [(a.split(), b.split()) for a, b in pairs[::5]] + [("x" * 5000, "y" * 4000), ("ab" * 3000, "ba" * 3000), ("", "a"), ("a", "a")]
    pairs += [("".join(map(chr, range(256, 9000))), "".join(map(chr, range(300, 9100, 1))).replace("Ā", "a")), ("𝄞ab" * 200, "b𝄞a" * 200)]
    want = [len(a) + len(b) if not a or not b else distance._bits(a, b) for a, b in pairs]
    texts_only = [i for i, (a, _) in enumerate(pairs) if isinstance(a, str)]
    assert distance.all_edits([pairs[i] for i in texts_only]) == [want[i] for i in texts_only]
    lists = [i for i in range(len(pairs)) if i not in texts_only]
    assert distance.all_edits([pairs[i] for i in lists]) == [want[i] for i in lists]
    for slack, n in ((distance.SLACK, 240), (1 << 40, 60)):  # each way on its own; narrow waves find all that the items tell nearly
        some = [(pairs[i], want[i]) for i in texts_only[:n] if min(map(len, pairs[i])) > 128]
        got = distance._waves([p for p, _ in some], slack, [min(map(len, p)) - 1 for p, _ in some])
        assert all(g in (w, None) if slack == distance.SLACK else g == w for g, (_, w) in zip(got, some)) and sum(g is not None for g in got) > 30
    long = [(t, t.replace("th", "tn").replace("er ", " ") + " the end") for t in (" ".join(rng.choices(words + "some plain words in a row that stay as they are".split(), k=1000)) for _ in range(60))]
    began = time.perf_counter()
    got = distance.all_edits(long)
    waves, began = time.perf_counter() - began, time.perf_counter()
    assert got == [distance._banded(a, b, d + 1) for (a, b), d in zip(long, got)]
    assert waves < time.perf_counter() - began


def test_single_spaces_are_not_replaced_one_by_one(monkeypatch):
    """Blanks of all kinds count as before; the pattern of blanks is for odd ones only."""
    rng, signs = random.Random(7), [*markup.SPACES, *"\x1c\x1f\x85​ab -‘—‐X"]
    for _ in range(5000):
        text = "".join(rng.choices(signs, k=rng.randrange(12)))
        want = unicodedata.normalize("NFKC", markup.plain(text)).translate(markup.PLAIN)
        assert markup.normal(text) == markup._RUN.sub(" ", want).strip(" ").lower()
    monkeypatch.setattr(markup, "_RUN", None)
    assert markup.normal("Some \n words\u3000 ") == "some words"
