import hashlib

import pytest

from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_near import kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm import classifier, packing, queries, rules  # noqa: E402


def test_stages_equal_brute_force(spark):
    """Every stage on its predecessor's result, over the whole small table."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = []
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        made.append([r.asDict() for r in at.collect()])
        if len(made) < 5:
            assert at.columns == docs.columns
            at = spark.createDataFrame([tuple(r.values()) for r in made[-1]], docs.schema)
    keep = lambda stage: {(r["doc_id"], r["text"]) for r in made[stage]}

    good = [(d, t) for d, t in rows if rules.first_failure(rules.Text(t.encode()), rules.RULES) is None]
    assert keep(0) == set(good) and len(good) < len(rows)
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    liked = [(d, t) for d, t in good if model.scores([t.encode()])[0] >= 0.5]
    assert keep(1) == set(liked)
    first = kept(liked)
    single = [(d, t) for d, t in liked if d in first]
    assert keep(2) == set(single) and len(single) < len(liked)
    cut = brute.substring(single)
    assert {r["doc_id"] for r in made[3]} == {d for d, _ in single}
    for r in made[3]:
        n, lost, sha = cut[r["doc_id"]]
        own = brute.words(r["text"])
        assert len(own) == n - lost and hashlib.sha256(" ".join(own).encode()).hexdigest() == sha
        assert r["n_chars"] == len(r["text"])
    plain = Tokenizer.from_file(queries.tokenizer_file(queries.BYTE_BPE))
    want = set()
    for r in made[3]:
        ids, start = brute.ids(plain, r["text"], 2), 0
        for i, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.add((r["doc_id"], i, start, n, brute.crc(ids[start : start + n])))
            start += n
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made[4]} == want
    total = sum(r["length"] for r in made[4])
    assert len({r["sequence_id"] for r in made[4]}) <= total / 1024 * 1.03 + 2


def test_stages_take_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns, and no rows."""
    from pyspark.sql import functions as F

    text = " ".join(f"word{i} other{i * 7}" for i in range(200))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, text + " end", "en", None, None),
            (None, text, "en", "s", 1), (4, " ".join(f"a{i}" for i in range(100_000)), "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumn("fp", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("length", F.lit("y")).withColumn("places", F.lit(2)).withColumn("quality_score", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        for d in (odd, odd.limit(0)):
            made = stage(spark, d, SF)
            n = made.count()
            if name != "best_fit_packing":
                assert made.columns == odd.columns
            assert n or d is not odd or name.startswith("quality")
