"""Hard negatives, language identification and whitening against brute force."""

import math
import random
import zlib

import numpy as np
import pytest

from tests.conftest import SF

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import language, negatives, queries, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label long, n long, w string"
LONG = 1 << 63


def vectors(spark, rows):
    """(vec_id, vector, label) with columns besides whose names clash with what the operators use."""
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], VECTORS)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def near_long(x):
    return max(-LONG, min(LONG - 1, x))


def mined(rows, k=5):
    usable = [(i, [near_long(math.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if i is not None and label is not None and good(v)]
    out = []
    for a, v, label in {(i, tuple(v), label) for i, v, label in usable if i % 100 == 0}:
        scored = [(near_long(sum(x * y for x, y in zip(v, w))), i, other) for i, w, other in usable if i != a and len(w) == len(v)]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p, positive, _ in [s for s in order if s[2] == label][:k]:
            fit = [s for s in order if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:k]
            out += [(a, positive, r, i, p, s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def embeddings(rng, n, dims=24):
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.5, dims)], int(rng.integers(0, 3))) for i in range(n)]
    copy = rows[5][1]
    rows += [(n + i, copy, i % 2) for i in range(30)]  # ties
    rows += [rows[7], rows[100], rows[100], (400, [0.0] * dims, 1), (500, [-x for x in copy], 0), (None, copy, 1), (1000, None, 1), (1001, [], 1), (1002, copy, None),
             (1003, [float("nan")] * dims, 1), (1004, [None, *copy[1:]], 1), (1005, [float("inf"), *copy[1:]], 0), (600, copy[:3], 1), (601, copy[1:4], 1), (602, copy[2:5], 2)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"anchor_batch": 2, "vector_block": 16}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = embeddings(np.random.default_rng(3), 310)
    found, _ = negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, **sizes)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows) != []


def test_hard_negatives_of_huge_values(spark):
    rows = [(100 * i, [3e38 if i % 3 else -3e38, 1.5, float(i)], i % 2) for i in range(8)] + [(1, [3e38, 3e38, 3e38], 0), (2, [3e38, 3e38, 3e38], 1)]
    found, _ = negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows) != []


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.mine(vectors(spark, []), F.col("vec_id") % 100 == 0)[0].collect() == []


def test_intervals_hold_the_true_scores_and_leave_most_rows_out():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    block = negatives.Block(np.arange(4000), np.zeros(4000, np.int64), v, negatives.encode(v))
    for q, planes in zip(v[:20], negatives.asked_planes(v[:20])):
        rows, exact = np.arange(4000), v @ q
        bounds = block.intervals(planes, rows)
        low, high = next(bounds)
        widths = []
        for _ in range(negatives.LEVELS):
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
            try:
                low, high = bounds.send(rows)
            except StopIteration:
                break
        assert len(widths) == negatives.LEVELS and all(b < 0.7 * a for a, b in zip(widths, widths[1:]))
        (best,), scored = block.best(q, planes, rows, [(-LONG, LONG - 1)], 5)
        assert best[1].tolist() == sorted(exact.tolist(), reverse=True)[:5] and scored < 800


def longest_matches(text, body):
    """Phrases of ``text``, each the longest stretch that ``body`` holds, or one symbol."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in body:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_phrases_equal_longest_matches(monkeypatch, few):
    monkeypatch.setattr(language, "FEW", few)
    rng = random.Random(1)
    bodies = [b"abcab b\xc3\xa9 zz", b"hello world abracadabra", b"x", b"aaaaaaaaab", bytes(rng.choice(b"abc ") for _ in range(500))]
    model = language.Model.of([(str(i), len(b), *language.table(language.suffix_automaton(b))) for i, b in enumerate(bodies)])
    texts = [bytes(rng.choice(b"abcdrhelo wx\xc3\xff\x00z") for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(120)] + [b"abc" * 400, bodies[4] * 3]
    assert model.phrases(texts).tolist() == [[longest_matches(t, b) for b in bodies] for t in texts]
    assert model.phrases([]).shape == (0, 5) and model.phrases([b"", b""]).sum() == 0


def test_suffix_automaton_holds_all_substrings_and_no_others():
    rng = random.Random(2)
    for _ in range(30):
        body = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40)))
        edges = language.suffix_automaton(body)
        paths, now = {b""}, [(b"", 0)]
        while now:
            now = [(w + bytes([c]), t) for w, s in now for c, t in edges[s].items()]
            paths |= {w for w, _ in now}
        assert paths == {body[i:j] for i in range(len(body) + 1) for j in range(i, len(body) + 1)}


LANGUAGES = "doc_id long, text string, lang string, score double, size long"


def test_language_of_odd_rows(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "the house and the garden were quiet" if i % 2 else "das haus und der garten waren still", "en" if i % 2 else "de", 0.0, 1) for i in ids]
    odd = [None, "", " \n\t", "123 !?", "the garden", "der garten", "日本語", "The House " * 20_000]
    rows += [(1000 + i, t, None, 0.0, 1) for i, t in enumerate(odd)] + [(None, "the house", "en", 0.0, 1), (5, None, "en", 0.0, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, LANGUAGES)
    found = [tuple(r) for r in language.predict(docs, language.fit(docs)).collect()]
    assert len(found) == len(rows) and all(0 <= s <= 1 for *_, s in found)
    got = {i: (lang, s) for i, lang, s in found}
    assert [got[1000 + i][0] for i in range(8)] == ["und", "und", "und", "und", "en", "de", got[1006][0], "en"] and got[1006][0] in ("de", "en")
    assert all(got[1000 + i][1] == 0 for i in range(4)) and got[None][0] == "en"
    nothing = language.fit(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language.predict(docs.where("false"), language.fit(docs)).collect() == []
    only = language.predict(docs, language.fit(docs.where("lang = 'en'"))).where("doc_id = 1005").collect()
    assert [(r["lang_pred"], r["score"]) for r in only] == [("en", 1.0)]


def test_language_learns_from_no_held_out_row_and_within_its_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    garbled = docs.withColumn("text", F.when(language.held_out(), "zzz qqq").otherwise(F.col("text"))).withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    again = language.fit(garbled)
    assert again.languages == model.languages and all(np.array_equal(a[1], b[1]) for a, b in zip(model.tables, again.tables))
    small = language.fit(docs, fit_bytes=3000)
    assert small.languages and all(2**b <= 3000 + language.FIT_ROWS for b in small.bits)


def test_languages_of_the_registered_query(spark):
    got = {r["doc_id"]: r for r in queries.op12_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    right = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if d["lang"] and any(c.isalpha() for c in d["text"] or "") and got[d["doc_id"]]["held_out"]]
    assert sum(right) > 0.97 * len(right)


def whitened(rows, k=8):
    """(ids, n, deviations, components, eigenvalues, trace, whitened) by NumPy and Python's integers."""
    usable = [(i, [near_long(min(math.floor(1024 * float(np.float32(x))), LONG - 1 - 100_000)) + 100_000 for x in v]) for i, v, *_ in rows if good(v)]
    n = len(usable)
    sums = [sum(c) for c in zip(*(x for _, x in usable))]
    scaled = [[n * a - s for a, s in zip(x, sums)] for _, x in usable]
    z = np.array([[a / n for a in x] for x in scaled])
    e, u = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)[:k]
    e, u = e[order], u[:, order]
    return [i for i, _ in usable], n, [near_long(sum(a * a for a in x)) for x in scaled], e, np.trace(z.T @ z / n), z @ u / np.sqrt(np.maximum(e, 1e-300))


def checked(spark, rows, k):
    ids, n, deviations, e, trace, w = whitened(rows, k)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n} and {r["identity_error"] <= 1e-4 for r in got} == {True}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviations))
    assert all(abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-9 * r["explained"] for r in got)
    for c in range(1, k + 1):
        mine = {(r["vec_id"], r["deviation"]): r["whitened"] for r in got if r["component"] == c}
        theirs = {(i, d): x for i, d, x in zip(ids, deviations, w[:, c - 1])}
        sign = 1 if max(abs(mine[p] - theirs[p]) for p in mine) < 1e-6 else -1
        assert mine.keys() == theirs.keys() and max(abs(mine[p] - sign * theirs[p]) for p in mine) < 1e-6
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0.1, 1, 12) * np.linspace(0.2, 3, 12)], 1) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[4][1], None), (900, None, 1), (901, [], 1), (902, [None] * 12, 1), (903, [float("inf")] * 12, 1)]
    checked(spark, rows, 8)


def test_whitening_of_few_and_large_components(spark):
    rng = np.random.default_rng(10)
    flat = [(i, [float(x), 2 * float(x), 5.0], 1) for i, x in enumerate(rng.integers(-9, 9, 40))]  # rank 1
    assert {r["component"] for r in checked(spark, flat, 1)} == {1}
    huge = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 3) * [1e18, 1e17, 1e16]], 1) for i in range(40)]
    checked(spark, huge, 3)
    assert len(whitening.whiten(vectors(spark, [(1, [3e38, -3e38], 1), (2, [1.0, 2.0], 1)])).collect()) == 2


def test_whitening_without_spread_and_by_length(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1)])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 1) for i in range(5)])).collect() == []
    two = [(i, [float(i), float(i * i % 7)], 1) for i in range(20)] + [(100 + i, [float(i % 5), 1.0, float(i)], 1) for i in range(30)]
    got = whitening.whiten(vectors(spark, two)).collect()
    assert {(r["vec_id"] >= 100, r["n"]) for r in got} == {(False, 20), (True, 30)} and len(got) == 20 * 2 + 30 * 2


def test_factor_and_rotation():
    rng = np.random.default_rng(11)
    for d, r in ((1, 1), (2, 2), (7, 3), (12, 12), (33, 20)):
        b = rng.normal(size=(d, r)) * np.logspace(0, -4, r)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= r and np.allclose(factor @ factor.T, a, atol=1e-12)
        x = whitening.one_sided_jacobi(factor)
        want = np.linalg.eigvalsh(a)[::-1][: x.shape[1]]
        norms = (x * x).sum(axis=0)
        assert np.allclose(norms, want, rtol=1e-6, atol=1e-13) and np.abs((x.T @ x) / np.sqrt(np.outer(norms, norms)) - np.eye(x.shape[1])).max() < 1e-12


def test_limbs():
    for x in (0, 1, -1, 2**31, -(2**32), 2**190 + 5, -(2**190) - 3, LONG, -LONG):
        assert sum(v << 32 * i for i, v in enumerate(whitening._limbs(x))) == x and all(-LONG <= v < LONG for v in whitening._limbs(x))
