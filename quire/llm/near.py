"""Near-duplicate texts: Jaccard similarity of at least 0.8 between sets of five-word shingles.

1. Sets: every document in one pass over its whole text; equal sets become one node (a 128-bit digest).
2. Candidates: SimHash. The fingerprint of a set has the bits that most of its shingle hashes have; fingerprints within ``RADIUS`` bits are linked
   (:func:`quire.llm.simhash.links`), and the nodes of one component of them are a bucket. A pair at 0.8 differs in 9 to 10 of 64 bits, so buckets of
   MinHash values are added, lest links between less alike texts be lost: ``BANDS`` keys of ``ROWS`` values each. A pair of similarity s shares a
   key with probability 1 - (1 - s^6)^32: 0.99994 at 0.8, more above it. The nodes of one key are a bucket, too.
3. Stars: all nodes of a bucket meet the one that most others share buckets with, and exact similarities are worked out: a group of copies costs as many
   pairs as it has members.
4. Buckets whose nodes are in several components still go, with their sets, to tasks of bounded size,
equal buckets once: each compares the sets of different components exactly,
   as rows of bits over the shingles that several of them hold, and sends a spanning link for each two components that it joins, never its pairs. A bucket of more
   than ``TILE_NODES`` nodes or ``TILE_SHINGLES`` shingles is dealt into tiles by hashes of its nodes; every two tiles are a task. No bucket is capped.
5. Components of all links, as in :mod:`quire.llm.simhash`. Links chain: two texts of one component can be less alike than 0.8.

Defined cases: null or empty texts have the empty set and are copies of each other; a text of five words or fewer is one shingle. Words are compared in
ASCII lower case, shingles by 64-bit hashes. Very long texts are compared whole. Ties in similarity at 0.8 are links. Repeated rows are copies: one stays. Null
ids rank behind all others. An
empty table stays empty. Other columns go through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.llm.shared import as_bytes, drop_table, write_table
from quire.llm.simhash import RADIUS, components, links, majority

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 32, 6
SIMHASH = -1  # the band of SimHash buckets
TILE_NODES, TILE_SHINGLES = 512, 1 << 19
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, 42)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    pairs = zip(start[: n - width + 1].tolist(), end[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, n - width + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of the MinHash values of a set; none for the empty set, which only equals itself."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, (_TIMES[:, None] * hashes[None, i : i + 1024] + _PLUS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in low.reshape(BANDS, ROWS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sketches(texts: pa.Array) -> pa.Array:
    digests, sizes, fps, keys = [], [], [], []
    for t in texts:
        h = shingles(t.as_py())
        digests.append(xxhash.xxh3_128_digest(h.tobytes()))
        sizes.append(len(h))
        fps.append(majority(h))
        keys.append(band_keys(h))
    made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(made, ["digest", "n", "fp", "keys"])


def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    read = lambda x: np.frombuffer(x.as_py(), np.uint64)
    return pa.array([similarity(read(x), read(y)) >= LEAST for x, y in zip(a, b)], pa.bool_())


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row of each component: the smallest doc_id, nulls last; of repeated rows one."""
    columns = docs.columns
    sketch = arrow_udf(_sketches, "digest binary, n long, fp long, keys array<long>")(as_bytes())
    marked = docs.withColumn("__near_row", F.monotonically_increasing_id()).withColumn("__near", sketch)
    marked = write_table(marked, "near-marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__near_row").alias("row"))
    found = marked.select(first.alias("first"), "__near.*").groupBy("digest")
    sets = write_table(found.agg(F.min("first").alias("first"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "near-sets")
    edges, done = _links(marked, sets)
    linked = write_table(components(edges), "near-components")
    for table in done:
        drop_table(table)
    roots = sets.select("first", F.col("first.row").alias("node")).join(linked, "node", "left")
    chosen = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return marked.join(chosen.select(F.col("first.row").alias("__near_row")), "__near_row", "left_semi").select(*columns)


def buckets(sets: DataFrame) -> DataFrame:
    """(node, n, band, key): each node once for the component of its SimHash fingerprint and once for each of its MinHash keys. The empty set is in none."""
    some = sets.where("n > 0").select(F.col("first.row").alias("node"), "n", "fp", "keys")
    linked = write_table(components(links(some.select("fp").distinct(), RADIUS)), "near-simhash").toDF("fp", "root")
    near = some.join(linked, "fp", "left").select("node", "n", F.lit(SIMHASH).alias("band"), F.coalesce("root", "fp").alias("key"))
    return near.unionByName(some.select("node", "n", F.posexplode("keys").alias("band", "key")))


def _links(marked: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect all nodes of ``sets`` that share a bucket and are alike, and the tables that nothing needs once these are used."""
    keyed = buckets(sets)
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = write_table(keyed.join(sizes, ["band", "key"]), "near-met")
    # a node that meets many others is the likeliest centre of its copies
    fame = met.groupBy("node").agg(F.sum("size").alias("fame"))
    shared = write_table(met.drop("size").join(fame, "node"), "near-buckets")
    bodies = marked.join(fame.select(F.col("node").alias("__near_row")), "__near_row", "left_semi").select(F.col("__near_row").alias("node"), arrow_udf(_sets, "binary")(as_bytes()).alias("set"))
    bodies = write_table(bodies, "near-bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")
        return write_table(sides.where(arrow_udf(_alike, "boolean")("x", "y")).select("a", "b"), "near-links")

    hubs = (shared.groupBy("band", "key").agg(F.max(F.struct("fame", F.negative("node").alias("minus"), "n")).alias("h"))
        .select("band", "key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n")))
    star = shared.join(hubs, ["band", "key"]).where((F.col("node") != F.col("hub")) & _may(F.col("n"), F.col("hub_n")))
    edges = verified(star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    rooted = shared.select("band", "key", "node", "n").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = write_table(rooted, "near-rooted")
    more = write_table(across(rooted, bodies), "near-across")
    for done in (met, rooted, shared, bodies):
        drop_table(done)
    return edges.unionByName(more), [edges, more]


def across(rooted: DataFrame, bodies: DataFrame, tile_nodes: int = TILE_NODES, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links (a, b) that join the components (root) of nodes of one bucket (band, key) that are alike."""
    own = F.xxhash64("node")
    facts = [F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 20)).alias("s")]
    buckets = rooted.groupBy("band", "key").agg(*facts).where("lo <> hi")
    # many keys gather the same nodes: one bucket of them will do
    once = buckets.groupBy("size", "shingles", "x", "s").agg(F.min(F.struct("band", "key")).alias("k")).select("k.*", "size", "shingles")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / tile_nodes), F.ceil(F.col("shingles") / tile_shingles)).cast("long")
    dealt = rooted.join(once.select("band", "key", tiles.alias("tiles")), ["band", "key"]).withColumn("tile", F.pmod(own, "tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = dealt.select("band", "key", "node", "root", "tile", other.alias("other")).select("band", "key", "node", "root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    return met.join(bodies, "node").groupBy("band", "key", "i", "j").applyInArrow(_joined, "a long, b long")


def _joined(rows: pa.Table) -> pa.Table:
    """A link for each two components of these nodes that are alike somewhere."""
    node, root = (rows.column(c).to_numpy() for c in ("node", "root"))
    order = np.lexsort((node, root))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
    sets, node = [sets[i] for i in order], node[order]
    _, part = np.unique(root, return_inverse=True)
    part, sizes = part[order], np.array([len(x) for x in sets])
    found: list[tuple[int, int]] = []
    if part[-1] > part[0]:
        held, counts = np.unique(np.concatenate(sets), return_counts=True)
        held = held[counts > 1]  # a shingle of one set is in no intersection
        bits = np.zeros((len(sets), max(1, -(-len(held) // 64))), np.uint64)
        for row, s in zip(bits, sets):
            at = np.searchsorted(held, s)
            at = at[held[np.minimum(at, len(held) - 1)] == s].astype(np.uint64) if len(held) else at[:0].astype(np.uint64)
            np.bitwise_or.at(row, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        for i in range(len(sets)):
            later = np.flatnonzero((part != part[i]) & (np.arange(len(sets)) > i) & (np.minimum(sizes, sizes[i]) >= LEAST * np.maximum(sizes, sizes[i]) - 1e-6))
            while len(later):  # of each other component the first that is alike
                step, later = later[:TILE_NODES], later[TILE_NODES:]
                both = np.bitwise_count(bits[step] & bits[i]).sum(axis=1, dtype=np.int64)
                for k in step[both / (sizes[step] + sizes[i] - both) >= LEAST].tolist():
                    if part[k] != part[i]:
                        found.append((int(node[i]), int(node[k])))
                        part[part == part[k]] = part[i]
                later = later[part[later] != part[i]]
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _may(n, m):
    """Whether sets of these sizes can be alike."""
    return F.least(n, m) >= LEAST * F.greatest(n, m) - 1e-6
