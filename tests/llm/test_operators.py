import random
import shutil
import tempfile

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm import brute

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import chat, classifier, packing, queries, rules, simhash, store, substring, tokens, topk, unigram, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "two words", "a b c", "é😀 ü\x0bx\x0cy \x1c z", "x" * 5000, "a " * 40, "| | |", "Tab\tand\r\nline  ends \n"]


def words(rng, n, most=400):
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, overlapping shared windows, one word over and over, a very long text."""
    rng = random.Random(7)
    rows, passage = [], " ".join(words(rng, 60, 10**6))
    for i in range(40):
        own = words(rng, rng.choice([3, 12, 13, 14, 60, 200]), 10**6)
        if i % 4 == 1:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage.split()[rng.randrange(20) : rng.randrange(35, 60)]
        rows.append(" ".join(own))
    rows += [rows[3], rows[3], rows[11] + " tail", "a " * 300, "a b " * 200, "a " * 299 + "c", " ".join(words(rng, 60_000, 10**6)), passage + "\n" + passage]
    for i in range(6):  # near copies: one word differs
        own = rows[5 + 4 * i].split() * 3
        own[len(own) // 2] = f"new{i}"
        rows += [" ".join(rows[5 + 4 * i].split() * 3), " ".join(own).upper()]
    return list(enumerate(rows + ODD))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    want = brute.components(rows)
    assert len({c for _, c in want.values()}) < len(want) - 5
    for hot in (4096, 1):  # 1: every bucket is keyed again
        got = simhash.near_duplicates(frame(spark, rows), hot=hot).collect()
        assert {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got} == want


def test_simhash_bit_slices(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 3, np.uint64)
    fps = np.unique(np.concatenate([base[i % 3] ^ sum((np.uint64(1) << rng.integers(0, 64, 1500, np.uint64) for _ in range(i % 5)), np.zeros(1500, np.uint64)) for i in range(8)]))[:2500]
    for radius in (0, 1, 2, 3, 4):
        for run in (np.zeros(len(fps), int), np.sort(rng.integers(0, 60, len(fps)))):
            a, b = simhash.forest(fps, run, radius)
            up = np.arange(len(fps))
            for x, y in zip(a, b):
                up[up == up[y]] = up[x]
            want = np.arange(len(fps))
            near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (run[:, None] == run[None, :])
            while True:
                low = np.where(near, want[None, :], len(fps)).min(axis=1)
                if (low == want).all():
                    break
                want = low
            assert len({*zip(up.tolist(), want.tolist())}) == len(set(up.tolist())) == len(set(want.tolist()))


def test_simhash_tiles_of_a_bucket(spark):
    """Of a bucket that stays large under finer keys all members meet in two tiles, and no key holds more than two tiles of it."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False)) for _ in range(300)})
    keyed = spark.createDataFrame([(0, 7, f) for f in fps] + [(0, 8, f) for f in fps[:20]], "mask int, key long, fp long")
    tiled: dict = {}
    for r in simhash._tiled(keyed, 40).collect():
        tiled.setdefault((r["mask"], r["key"]), []).append(r["fp"])
    assert sorted(tiled.pop((0, 8))) == fps[:20]
    met = {(a, b) for members in tiled.values() for a in members for b in members}
    assert met == {(a, b) for a in fps for b in fps} and max(map(len, tiled.values())) < 40 * 4
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=16).collect()]

    def groups(links):
        up = {f: f for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            low, high = sorted((root(a), root(b)))
            up[high] = low
        return {f: root(f) for f in fps}

    assert groups(edges) == groups([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])


def test_simhash_null_ids_and_pipeline_form(spark):
    rows = [(None, "p q r s"), (None, "p q r s"), (5, "p q r s"), (4, "P Q R S"), (None, "z y x w"), (9, None), (8, ""), (7, "k l m n"), (7, "k l m n")]
    d = frame(spark, rows).withColumn("fp", F.lit("own")).withColumn("component_id", F.lit(1))
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()) == [(4, "P Q R S"), (7, "k l m n"), (8, "")]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0 and simhash.near_duplicates(d.limit(0)).count() == 0
    assert simhash.near_duplicates(d).count() == len(rows)


def _cut(spark, d):
    from pyspark.sql import functions as F

    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return substring.drop_repeats(d).select("doc_id", "n_words", "n_removed", F.sha2(text, 256).alias("sha"), "text")


def test_substring_equals_brute_force(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in _cut(spark, frame(spark, rows)).collect()}
    assert got == brute.substring(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_substring_dense_repeats(spark):
    rng = random.Random(5)
    for most in (2, 3, 30):
        rows = [(i * 3 % 31, " ".join(words(rng, rng.randrange(5, 80), most))) for i in range(31)]
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in _cut(spark, frame(spark, rows)).collect()}
        assert got == brute.substring(rows)


def test_substring_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "_WORDS", 64)
    monkeypatch.setattr(substring, "_SLICE", 512)
    import pyarrow as pa

    rows = [t.encode() for _, t in corpus() if t]
    text = pa.array(rows, pa.binary())
    windows = 0
    for i, h, size, first, before in substring._documents(text):
        doc, begin, count, gram, content = substring._paths(h, size, first, 13)
        windows += int(count.sum())
        assert (count <= 11).all()
    assert windows == sum(max(0, len(t.split()) - 12) for t in rows)


def test_substring_edges(spark):
    p = " ".join(f"q{i}" for i in range(20))
    rows = [(None, p), (3, p), (3, p), (5, "x\n" + p + "\n\ny z"), (6, None), (7, p + " " + p)]
    d = frame(spark, rows).withColumn("n_words", F.lit("own")).withColumn("places", F.lit(1))
    got = substring.drop_repeats(d)
    assert got.columns == [*(c for c in d.columns if c != "n_words"), "n_words", "n_removed"]
    by = [(r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()]
    assert sorted(by, key=str) == sorted([(None, p, 0), (3, p, 0), (3, p, 0), (5, "x\ny z", 20), (6, None, 0), (7, "", 40)], key=str)
    assert substring.drop_repeats(d.limit(0)).count() == 0


def test_rules_equal_brute_force(spark):
    rows = corpus()
    got = rules.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        n, chars, symbols, dup, repeat = brute.rule_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert {r["kept"] for r in got} == {True, False}


def test_rules_order_and_filter(spark):
    d = frame(spark, corpus())
    order = rules.ordered(d)
    assert sorted(n for n, _ in order) == sorted(n for n, _ in rules.RULES)
    kept = rules.keep_good(d)
    assert kept.columns == d.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rules.report(d).where("kept").collect()}
    assert rules.keep_good(d.limit(0)).count() == 0 and [n for n, _ in rules.ordered(d.limit(0))] == [n for n, _ in rules.RULES]
    slow = ("slow", lambda t: len(t.words) >= 0 and sum(range(20000)) < 0)
    fast = ("fast", lambda t: t.n_symbols >= 0)
    assert [n for n, _ in rules.ordered(d, [slow, fast])] == ["fast", "slow"]


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model).join(labels, "doc_id").where(classifier.held_out())
    hit = scored.select((F.col("quality_score") >= 0.5).cast("int").alias("p"), "quality").groupBy("quality").agg(F.avg((F.col("p") == F.col("quality")).cast("int")).alias("a"))
    share = {r["quality"]: r["a"] for r in hit.collect()}
    assert min(share.values()) > 0.95, share


def test_classifier_equals_brute_force(spark):
    """Differences from sizes of chunks with each dictionary, a curve in nothing but them, monotone; dictionaries and curve from the rows that may be used."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    import zlib

    usable = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and text.get(r["doc_id"]) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows = {q: [text[d] for d in sorted((d for d in usable if usable[d] == q), key=order.get)] for q in (0, 1)}
    model = classifier.fit(docs, labels)
    assert model == classifier.learn(rows, {q: len(rows[q]) for q in (0, 1)})
    sizes = []
    for d in (model.good, model.bad):
        tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append({i: sum(len(tool.compress(t[k : k + 512])) for k in range(0, len(t), 512)) for i, t in text.items()})
    want = {i: np.interp((sizes[1][i] - sizes[0][i]) / len(t) if t else 0.0, model.at, model.worth) for i, t in text.items()}
    assert list(model.at) == sorted(model.at) and list(model.worth) == sorted(model.worth) and 0 <= model.worth[0] < 0.5 < model.worth[-1] <= 1
    got = queries.queries()["op3_quality_classifier"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_classifier_sample_is_bounded_by_bytes(spark):
    """Texts that don't fit are left out whole, and so is an id of very many rows; without them the model is the same."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    usable = [r["doc_id"] for r in labels.where("quality in (0, 1)").where(~classifier.held_out()).orderBy("doc_id").collect()]
    least = docs.where("text <> ''").where(F.col("doc_id").isin(usable[:40])).select("doc_id", "text")
    want = classifier.fit(least.where(F.col("doc_id") != usable[0]), labels)
    long = least.withColumn("text", F.when(F.col("doc_id") == usable[0], F.repeat("text", 5000)).otherwise(F.col("text")))
    many = least.where(F.col("doc_id") == usable[0]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("n")
    bytes_ = least.select(F.sum(F.octet_length("text"))).first()[0]
    first = lambda m: (m.good, m.bad)
    for odd in (long, least.where(F.col("doc_id") != usable[0]).unionByName(many)):
        assert first(classifier.fit(odd, labels, fit_bytes=bytes_)) == first(want)
        assert first(classifier.fit(odd, labels)) != first(want) or odd is not long


def test_calibration_finds_the_curve():
    rng = np.random.default_rng(2)
    x = rng.normal(0.02, 0.05, 20000)
    true = lambda v: 1 / (1 + np.exp(-(60 * v - 1)))
    at, worth = classifier.calibrate(x, (rng.random(20000) < true(x)).astype(float), np.ones(len(x)))
    assert max(abs(np.interp(v, at, worth) - true(v)) for v in np.linspace(-0.05, 0.1, 31)) < 0.08
    # every rising curve of few values is farther away
    x, y = np.arange(7.0), np.array([0, 1, 0, 0, 1, 1, 0.0])
    pools = classifier.calibrate(x, y, np.ones(7))[0]
    assert pools == (0.0, 2.0, 5.0)


def test_classifier_edges(spark):
    d = frame(spark, corpus()).withColumn("quality_score", F.lit("own"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, none)
    assert {r["quality_score"] for r in classifier.score(d, model).collect()} == {0.5}
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, few)
    got = classifier.score(d, model)
    assert got.count() == d.count() and got.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert classifier.keep_good(d, model).columns == d.columns
    assert classifier.score(d.limit(0), model).count() == 0
    held = d.select("doc_id", classifier.held_out().alias("h")).collect()
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)


@pytest.mark.parametrize("name", [queries.BYTE_BPE, queries.WORD_BPE])
def test_unit_tokenizer_equals_the_library(name):
    t = tokens.UnitTokenizer(queries.tokenizer_file(name), cache=50)
    texts = [x or "" for _, x in corpus() if len(x or "") < 9000] + ["  a  b\n c", " x\n\n y  ",
        "don't we'll  İstanbul ß \x1c z <|endoftext|> <|startoftext|>", "é ́x 1234 ½ ΣΑΣ Σ", "\0a b", "日本 語 ok 😀 b", "a \xa0 b c d"]
    for _ in range(2):
        for text, got in zip(texts, t.encode(texts)):
            assert np.array_equal(got, t.tokenizer.encode(text, add_special_tokens=False).ids), text


def test_unit_tokenizer_learns_runs_once_and_keeps_what_comes_again(monkeypatch):
    t = tokens.UnitTokenizer(queries.tokenizer_file(queries.WORD_BPE), cache=100)
    asked, encode = [], t._encode_units
    monkeypatch.setattr(t, "_encode_units", lambda text, start, end: asked.extend(bytes(text[a:b]) for a, b in zip(start, end)) or encode(text, start, end))
    often = "Often often, OFTEN. (often) don't Don't \u00e9t\u00e9s-\u00c9"
    rng = np.random.default_rng(5)
    for i in range(40):
        text = often + " " + " ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(20))
        assert np.array_equal(t.encode([text])[0], t.tokenizer.encode(text, add_special_tokens=False).ids)
    for unit in (b"often", b",", b"(", b"don't", b"Don't", "\u00e9t\u00e9s".encode()):
        assert asked.count(unit) == 1, unit  # the cache was full several times
    assert b"often," not in asked and t.count <= 100


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.BYTE_BPE)
    plain = Tokenizer.from_file(path)
    rows = corpus() + [(None, "null id"), (None, "null id"), (0, "same id"), (0, "same id"), (2**60 + 1, "a long id"), (2**60 + 3, "a long id"), (5000, "long " * 5000)]
    d = frame(spark, rows).withColumn("length", F.lit("own")).withColumn("sequence_id", F.lit("own"))
    got = packing.pack_documents(d, path, 2, group_items=16).collect()
    by_bin, by_doc = {}, {}
    for r in got:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for d_id, text in rows:
        ids = brute.ids(plain, text, 2)
        own = [r for r in by_doc[d_id]]
        want = [(i, s, n, brute.crc(ids[s : s + n])) for i, (s, n) in enumerate(_spans(len(ids)))]
        assert set(want) <= {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own}
    total = sum(len(brute.ids(plain, t, 2)) for _, t in rows)
    assert sum(r["length"] for r in got) == total
    assert len(by_bin) <= total / 1024 * 1.02 + 8
    assert {r["doc_id"] for r in got} == {d_id for d_id, _ in rows}
    with_ids = packing.pack_documents(d, path, 2, group_items=16, with_ids=True).persist()
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(with_ids).collect()}
    assert max(map(len, whole.values())) <= 4096 and sum(map(len, whole.values())) == 4 * total
    back = {}
    for r in with_ids.collect():
        ids = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert brute.crc(np.frombuffer(ids, "<u4")) == r["ids_crc32"]
        back.setdefault((r["doc_id"], r["piece"]), []).append(ids)
    for d_id, text in rows:
        if sum(x == d_id for x, _ in rows) == 1:
            assert b"".join(back[d_id, i][0] for i in range(len(by_doc[d_id]))) == brute.ids(plain, text, 2).tobytes()
    with_ids.unpersist()
    assert packing.pack_documents(d.limit(0), path, 2).count() == 0


def _spans(n):
    at = 0
    for m in packing.cut_lengths(n, 1024):
        yield at, m
        at += m


def test_best_fit_obeys_every_capacity():
    rng = np.random.default_rng(1)
    lengths = -np.sort(-rng.integers(1, 1000, 3000))
    for capacity, rule in (((1024, 1024, 1 << 20), "norm"), ((1024, 3, 1 << 20), "norm"), ((1024, 1024, 1_000_000), "dot"), ((2048, 4, 1_200_000), "dot")):
        bins, offset = packing.best_fit(lengths, capacity, (1.0, 0.3, 0.3), rule)
        n = bins.max() + 1
        assert (np.bincount(bins, lengths) <= capacity[0]).all() and (np.bincount(bins) <= capacity[1]).all() and (np.bincount(bins, lengths.astype(float) ** 2) <= capacity[2]).all()
        assert n >= -(-lengths.sum() // capacity[0])
    bins, _ = packing.best_fit(lengths)
    assert bins.max() + 1 <= 1.02 * -(-lengths.sum() // 1024)
    scalar, _ = packing.best_fit(lengths, weights=(1.0, 0.0, 0.0))
    together = lambda b: {tuple(sorted(lengths[b == x])) for x in range(b.max() + 1)}
    assert together(bins) != together(scalar)  # documents and attention take part in the choice
    bins, _ = packing.best_fit(np.ones(1000, np.int64))
    assert np.bincount(bins).max() == packing.MAX_DOCUMENTS
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]))


@pytest.fixture
def folder():
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    yield f"file://{path}"
    shutil.rmtree(path)


def test_warc_round_trip(spark, folder):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 7 * 50)) for i in range(60)] + [(60, None, None), (61, "u\nv", ""), (62, "x", "é\r\n\r\n"), (70, "x", "z" * 3_000_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(1))
    manifest = warc.write(d, folder, file_bytes=20_000)
    assert manifest.count() > 4
    got = warc.read(manifest).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute.warc([(p, h) for p, _, h in rows]) and len(got) == len(rows)
    payload = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r["payload"]) == payload[r["page_id"]] for r in got if r["record_type"] == "response")
    assert {r["record_type"] for r in warc.archive(spark, d, folder + "/more", min_bytes=10**9).collect()} == {"response"}
    path = manifest.first()["path"]
    with open(path.removeprefix("file://"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"


def test_warc_edges(spark, folder):
    d = spark.createDataFrame([(None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (3, "u", "same"), (None, None, "lone")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(spark, d, folder).collect()), key=str)
    assert got == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (3, "revisit", 4), (None, "response", None)], key=str)
    assert warc.archive(spark, d.limit(0), folder + "/none").count() == 0


def test_store_round_trip(spark, folder):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.WORD_BPE)
    plain = Tokenizer.from_file(path)
    rows = corpus() + [(None, "null id")]
    random.Random(2).shuffle(rows)
    manifest = store.write(frame(spark, rows).withColumn("name", F.lit(1)), folder, path, 1)
    got = store.read(manifest, with_ids=True).collect()
    at = 0
    for d_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = brute.ids(plain, text, 1)
        r = next(r for r in got if r["doc_id"] == d_id)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids)) and bytes(r["ids"]) == ids.tobytes()
        at += len(ids)
    assert len(got) == len(rows)
    names = [bytes(r["name"]) for r in store.read_chunks(manifest).collect()]
    assert len(names) == len(set(names))
    assert store.read(store.write(frame(spark, rows).limit(0), folder + "/none", path, 1)).count() == 0


def test_store_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 49000, 60_000)
    b = np.concatenate([rng.integers(0, 49000, 777), a])
    sizes = np.diff([0, *store.cuts(a)])
    assert sizes.max() <= store.MAX_IDS and sizes[:-1].min() >= store.MIN_IDS and sizes.sum() == len(a)
    pieces = [{x[s:e].tobytes() for s, e in zip([0, *store.cuts(x)], store.cuts(x))} for x in (a, b)]
    assert len(pieces[0] & pieces[1]) > 0.7 * len(pieces[0])


def test_store_notices_damage(spark, folder):
    manifest = store.write(frame(spark, corpus()), folder, queries.tokenizer_file(queries.WORD_BPE), 1)
    path = manifest.where("kind = 'chunks'").first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(bytes(raw))
    with pytest.raises(Exception, match="damaged chunk"):
        store.read(manifest).collect()


def test_store_notices_lost_and_mixed_up_rows(spark, folder):
    manifest = store.write(frame(spark, corpus()), folder, queries.tokenizer_file(queries.WORD_BPE), 1)
    rows = [tuple(r) for r in manifest.collect()]
    again = lambda some: spark.createDataFrame(some, manifest.schema)
    assert store.read(again(rows[::-1])).count() == len(corpus())
    first = lambda kind: next(i for i, r in enumerate(rows) if r[0] == kind)
    for kind in ("recipes", "chunks", "manifest"):
        with pytest.raises(ValueError, match="does not match its root"):
            store.read(again([r for i, r in enumerate(rows) if i != first(kind)]))
    with pytest.raises(ValueError, match="does not match its root"):
        store.read(again(rows + [rows[0]]))
    a, b = [i for i, r in enumerate(rows) if r[0] == "recipes"][:2]
    swapped = list(rows)
    swapped[a], swapped[b] = (*rows[a][:3], rows[b][3], *rows[a][4:]), (*rows[b][:3], rows[a][3], *rows[b][4:])
    with pytest.raises(ValueError, match="does not match its root"):
        store.read(again(swapped))


def test_store_shares_passages(spark, folder):
    rng = random.Random(9)
    passage = " ".join(words(rng, 3000, 10**6))
    rows = [(i, " ".join(words(rng, 50, 10**6)) + " " + passage) for i in range(8)]
    manifest = store.write(frame(spark, rows), folder, queries.tokenizer_file(queries.WORD_BPE), 1)
    recipes = [bytes(r["recipe"]) for r in store.read_recipes(manifest).collect()]
    used = [r[i : i + store.NAME] for r in recipes for i in range(0, len(r), store.NAME)]
    assert store.read_chunks(manifest).count() == len(set(used)) < 0.5 * len(used)


def test_unigram_equals_the_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = queries.tokenizer_file(queries.PIECES)
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rows = [(d, t) for d, t in corpus() if len(t or "") < 9000] + [(900, "Hello  wörld\n日本 語 ok 😀"), (901, "  lead and trail  "), (902, "▁ marker"), (903, "\x01\x02")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = docs.select(F.explode(F.split("text", r"\s+")).alias("text")).distinct().limit(4000).collect()
    d = frame(spark, rows + [(1000 + i, r["text"]) for i, r in enumerate(parts)])
    text = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    got = unigram.encode(d, path).collect()
    model, same = unigram.Unigram(unigram.load_pieces(path)), 0
    score = lambda ids: sum(model.scores[i] for i in ids)
    for r in got:
        theirs = lib.encode(text[r["doc_id"]])
        same += list(r["ids"]) == theirs
        # never worse than the library, which adds in single precision; texts with byte pieces (-1e9) can't be compared so
        assert min([*r["ids"], *theirs], default=999) <= 258 or score(r["ids"]) >= score(theirs)
    assert same > 0.97 * len(got)
    back = {r["doc_id"]: r["text"] for r in unigram.decode(unigram.encode(d, path), path).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in text.items())
    assert unigram.encode(d.limit(0), path).count() == 0


def test_unigram_equals_all_segmentations():
    rng = random.Random(4)
    for _ in range(30):
        pieces = [("<unk>", 0.0, 2)] + [(p, rng.uniform(-6, -1), 1) for p in {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))) for _ in range(8)}]
        model = unigram.Unigram(pieces)
        scores = {p: s for p, s, t in pieces if t == 1}

        def best(s):
            if not s:
                return 0.0
            found = [scores[s[:n]] + best(s[n:]) for n in range(1, min(3, len(s)) + 1) if s[:n] in scores]
            return max(found + ([model.unknown_score + best(s[1:])] if s[0] not in scores else []), default=float("-inf"))

        text = "".join(rng.choice("ab c") for _ in range(9))
        ids = np.frombuffer(model.encode([text])[0], "<u4")
        got = sum(model.unknown_score if i == 0 else pieces[i][1] for i in ids)
        assert abs(got - best(model.marked(text).decode())) < 1e-9


def test_top_k_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(1000, None), (1050, [None] * 64), (1100, [float("nan")] * 64), (1150, [float("inf")] + [0.0] * 63), (1200, [1.0, 2.0]),
        (1201, [1.0, 2.0]), (1202, [1.0, 2.0]), (None, [1.0, 2.0]), (1250, [])]
    rows += [(1300, [3e38] * 2), (1301, [-3e38, 0.0]), (1302, [1e12, -1e12]), (1303, [3e38, -3e38]), (1350, [0.0, 0.0]), (1400, [0.5] * 64),
        (1450, [-3e38] * 64)] + [(2001 + i, [0.5] * 64) for i in range(120)]
    random.Random(3).shuffle(rows)
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("block", F.lit("own"))
    want = brute.top_k([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for sizes in ({"vector_block": 100, "query_batch": 3, "query_group": 6}, {}):
        found = topk.top_k(d, F.col("vec_id") % 50 == 0, **sizes).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found} == want and len(found) == len(want)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(twice, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 512 * 256), (1, 512 * 256), (2, 65536)]


def test_top_k_stops_early():
    rng = np.random.default_rng(0)
    x = (rng.exponential(1, (4000, 3)) * 1000).astype(np.int64)
    y = np.floor(256 * (g := rng.normal(size=(4096, 64))) / np.linalg.norm(g, axis=1)[:, None]).astype(np.int64)
    for vectors, share in ((x, 0.5), (y, 0.8)):
        lists, done = topk.Lists.of(np.arange(len(vectors)), vectors), 0
        for i in range(40):
            scores = vectors @ vectors[i]
            want = np.lexsort((np.arange(len(vectors)), -scores))
            best = want[want != i][:5]
            rows, score, read = lists.top(i, vectors[i], 5, int(scores[best[-1]]))
            assert (rows == best).all() and (score == scores[best]).all()
            done += read
            assert {*best} <= {*lists.candidates(vectors[i], 5, -np.inf, np.array([i]))[0]}
        assert done < share * 40 * vectors.size


def test_top_k_reads_part_of_the_lists(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    share = topk.share_read(topk.found_in_blocks(vectors, F.col("vec_id") % 50 == 0, vector_block=512)).first()["share_read"]
    print("share of the lists read at sf0.1:", share)
    assert share < 0.9


def test_chat_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = ["</turn>\n<part/>", '<turn role="user">', "&lt;&amp;&quot;", '">', "\\", "😀é" * 3000, None, "", "a\nb"]
    rows += [(5000 + i % 3, i, "assistant" if i % 4 > 1 else "user", t) for i, t in enumerate(tricky * 3)] + [(6000, 0, 'x">y', "t"),
        (6000, None, None, None), (None, 1, "user", "n"), (7000, 1, "assistant", "same"), (7000, 1, "assistant", "same")]
    rows += [(8000, i, ("user", "assistant")[i % 2], f"turn {i} <") for i in range(3000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = chat.format_chat(d)
    back = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    got = {r[0]: tuple(r[1:]) for r in back.select("conv_id", F.size("t"), F.sha2(lines, 256), F.length("loss"), F.sha2("loss", 256)).collect()}
    assert got == brute.chat(rows)
    assert chat.format_chat(d.limit(0)).count() == 0
    two = made.where("conv_id = 7000").first()["formatted"]
    assert two == '<turn role="assistant">same<part/>same</turn>\n'


def test_registered_queries_equal_brute_force(spark):
    """The thin queries, over whole tables."""
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    run = queries.queries()
    plain, want, at = Tokenizer.from_file(queries.tokenizer_file(queries.WORD_BPE)), {}, 0
    for d, t in sorted(rows):
        ids = brute.ids(plain, t, 1)
        want[d] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run["op7_token_store"](spark, SF).collect()} == want
    plain = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    pieces, bins = {}, {}
    for r in run["op2_best_fit_packing"](spark, SF).collect():
        pieces[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want, total = {}, 0
    for d, t in rows:
        ids = brute.ids(plain, t, 2)
        total += len(ids)
        want |= {(d, i): (s, n, brute.crc(ids[s : s + n])) for i, (s, n) in enumerate(_spans(len(ids)))}
    assert pieces == want and len(bins) <= 1.02 * total / 1024 + 2
    assert all(sum(n for _, n in own) <= 1024 and [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] for own in bins.values())
    import hashlib

    text = dict(rows)
    for r in run["op9_sentencepiece"](spark, SF).collect():
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").replace("▁", " ").encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == brute.crc(r["ids"])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run["op5_simhash"](spark, SF).collect()} == brute.components(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run["op8_substring_dedup"](spark, SF).collect()} == brute.substring(rows)
    chats = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    chats += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert {r[0]: tuple(r)[1:5] for r in run["op1_chat_format"](spark, SF).collect()} == brute.chat(chats)
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert {r["page_id"]: tuple(r)[1:] for r in run["op6_warc"](spark, SF).collect()} == brute.warc(pages)
