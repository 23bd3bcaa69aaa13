"""The pipeline's near-duplicate stage against all pairs of five-word sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import near
from quire.llm.simhash import components
from tests.conftest import SF
from tests.llm import brute


def kept(rows):
    """The smallest doc_id of each component of pairs whose shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in rows:
        w = brute.words(brute.lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in sets if find(d) == d}


def test_near_dedup_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == kept(rows)


def test_near_dedup_finds_small_changes(spark):
    """One changed word of fifty, chains of changes, and pairs on both sides of 0.8."""
    rng, rows = random.Random(7), []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([50, 120, 300]))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([1, 1, len(words) // 50, len(words) // 40])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
    assert 60 <= len(want) < len(rows) / 2


def test_near_dedup_of_a_group_of_unlike_copies(spark):
    """Short copies of one text with a word or two changed share most bands and are not alike; with none, or long ones, they are."""
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    for i in range(150):
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words if i % 5 else words + words[:9])))
    want = kept(rows)
    assert 40 < len(want) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_simhash_fingerprints_bring_candidates_together(spark):
    """Nodes within three bits, directly or over others, are a bucket even where no MinHash value is common; others are alone."""
    x = 0x0123456789ABCDEF
    rows = [(1, x, [11]), (2, x ^ 0b111, [12]), (3, x ^ 0b11111, [13]), (4, x, [14]), (5, x ^ 0xFFFFF, [15])]
    sets = spark.createDataFrame([((i,), 9, fp, keys) for i, fp, keys in rows], "first struct<row: long>, n long, fp long, keys array<long>")
    found = near.buckets(sets).groupBy("band", "key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1).collect()
    assert [(r["band"], r["nodes"]) for r in found] == [(near.SIMHASH, [1, 2, 3, 4])]


def test_fingerprint_of_a_set_has_the_bits_of_most_hashes():
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 1001, np.uint64)
    assert near.majority(hashes) == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes) * 2 > 1001)
    assert near.majority(hashes[:0]) == 0 and near.majority(np.array([5, 6], np.uint64)) == 4


@pytest.mark.parametrize("tiles", [(512, 1 << 19), (7, 1 << 19), (512, 300)])
def test_links_of_a_bucket_in_one_task_and_in_tiles(spark, tiles):
    """A bucket of sets on both sides of 0.8, some of them joined already, meets in one task or in pairs of tiles."""
    rng, sets = np.random.default_rng(5), []
    for _ in range(8):
        base = rng.integers(1, 1 << 62, 40, np.uint64)
        for _ in range(6):
            s = base.copy()
            s[: rng.integers(0, 7)] = rng.integers(1, 1 << 62)
            s[20 : 20 + rng.integers(0, 4)] = rng.integers(1, 1 << 62)
            sets.append(np.unique(s))
    sets.append(np.zeros(0, np.uint64))
    want = {i: i for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if want[i] != want[j] and near.similarity(a, b) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    rows = [(band, 9, i, i, len(s)) for band in (0, 1) for i, s in enumerate(sets)] + [(2, 1, 0, 0, len(sets[0])), (2, 1, 1, 0, len(sets[1]))]
    rooted = spark.createDataFrame(rows, "band int, key long, node long, root long, n long")
    bodies = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, set binary")
    links = near.across(rooted, bodies, *tiles)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(sets) - 10
    if tiles[0] == 512 and tiles[1] > 300:
        assert links.count() == len(sets) - len(set(want.values()))  # spanning links only, of one of the two equal buckets
