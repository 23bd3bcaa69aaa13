"""SimHash near-duplicates with a bit-sliced comparison.

1. Fingerprint: every document in one pass over its whole text (:func:`fingerprints`).
2. Candidates: two fingerprints within ``radius`` bits agree on some ``m - radius`` of ``m`` bit
   blocks, so each *distinct* fingerprint is keyed once per choice of blocks. A bucket of more than
   ``hot`` fingerprints is keyed again on its free bits, and what is still larger is cut into tiles of
   about ``hot``, of which each two meet: no task holds more than two tiles of a bucket.
3. Comparison: a task holds its buckets as bit planes (plane b = bit b of 64 fingerprints per word).
   A query XORs its bits with the planes and adds them by carry-save into counters that overflow at
   ``radius + 1``; a block is abandoned when every wanted lane has overflowed.
4. Each bucket sends a spanning forest (fewer edges than members), never its pairs; components come
   from alternating large-star and small-star joins on written tables.

Defined cases: null or empty text has fingerprint 0 and is linked like any other. Rows with a null
``doc_id`` are fingerprinted and link others; a component of only such rows has a null id. Repeated
rows all come back with their component. An empty table gives an empty result. Extra columns do not
matter: only ``doc_id`` and ``text`` are read. Very long texts are read whole; a bit that is set in just half of the shingles (a tie) is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.llm.shared import as_bytes, drop_table, write_table

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 5
HOT_BUCKET = 4096
_LANES = 512
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Majority fingerprint of a UTF-8 text, as an unsigned 64-bit number."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), n - width + 1
    for i in range(0, total, 1 << 16):
        j = min(i + (1 << 16), total)
        pairs = zip(start[i:j].tolist(), end[i + width - 1 : j + width - 1].tolist())
        counts += _bit_counts(np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, j - i))
    return _most(counts, total)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of these hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += _bit_counts(hashes[i : i + (1 << 16)])
    return _most(counts, len(hashes))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _most(counts: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""
    return docs.select("doc_id", arrow_udf(_fingerprints, "long")(as_bytes(text_col)).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], blocks: int, equal: int) -> list[int]:
    """A mask for each choice of ``equal`` of the ``blocks`` runs that ``bits`` are cut into."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for block in chosen for b in block) for chosen in combinations(cut, equal)]


def planes(fps: np.ndarray) -> np.ndarray:
    """The bit planes of fingerprints whose number is a multiple of 64: [bit, word], lane = bit of word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, lanes: np.ndarray, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``live`` with a lane left, and the lanes within ``radius`` bits of their query.

    ``live`` [query, word] marks the lanes that matter. Counters start so far up that they overflow
    with the bit after ``radius``; two planes go in at a time through a carry-save adder.
    """
    width = max(1, (radius + 1 - 1).bit_length())
    rows = np.flatnonzero(live.any(axis=1))
    queries, live = queries[rows], live[rows].copy()
    first = (1 << width) - 1 - radius
    count = [np.full(live.shape, _ALL if first >> i & 1 else 0, np.uint64) for i in range(width)]
    for b in range(0, 64, 2):
        if not len(rows):
            break
        x, y = (lanes[b + k][None, :] ^ (-(queries >> np.uint64(b + k) & np.uint64(1)))[:, None] for k in (0, 1))
        low = count[0] ^ x
        carry = (count[0] & x) | (y & low)
        count[0] = low ^ y
        for i in range(1, width):
            count[i], carry = count[i] ^ carry, count[i] & carry
        live &= ~carry
        if b % 8 == 6:
            left = live.any(axis=1)
            if not left.all():
                rows, queries, live, count = rows[left], queries[left], live[left], [c[left] for c in count]
    return rows, live


def forest(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (as indexes) between fingerprints within ``radius`` bits and of one ``run`` (sorted)."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)]
    tiles, a = [], 0  # whole runs together in one tile, a longer run alone in several
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - a > _LANES and s > a:
            tiles.append((a, s))
            a = s
        if e - s > _LANES:
            tiles += [(i, min(i + _LANES, e)) for i in range(s, e, _LANES)]
            a = e
    if a < len(run):
        tiles.append((a, len(run)))
    at = [(t, planes(np.pad(fps[t[0] : t[1]], (0, -(t[1] - t[0]) % 64)))) for t in tiles]
    for i, ((a, b), _) in enumerate(at):
        for (c, d), lanes in at[i:]:
            if run[c] > run[b - 1]:
                break
            wanted = (run[a:b, None] == run[None, c:d]) & (np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
            wanted = np.pad(wanted, ((0, 0), (0, -(d - c) % 64)))
            rows, hit = within(fps[a:b], lanes, np.packbits(wanted, axis=1, bitorder="little").view(np.uint64), radius)
            for q, lane in zip((rows + a).tolist(), np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")):
                mine = find(q)
                for other in np.unique(root[c + np.flatnonzero(lane)]).tolist():
                    other = find(other)
                    mine, low = max(mine, other), min(mine, other)
                    root[mine] = low
                    mine = low
            while not np.array_equal(up := root[root], root):
                root[:] = up
    child = np.flatnonzero(root != np.arange(len(root)))
    return root[child], child


def _edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Spanning edges of each (mask, key) bucket; rows of a bucket lie together in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            change = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]
            bucket = np.cumsum(change)
            size = np.bincount(bucket)[bucket]
            rows, bucket = rows[size > 1], bucket[size > 1]
            fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            a, b = forest(fps, bucket, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            if not len(last) and (not held or (held[-1][-1, :2] == rows[-1, :2]).all()):
                held.append(rows)
                continue
            cut = int(last[-1]) + 1 if len(last) else 0
            yield done(np.concatenate([*held, rows[:cut]]))
            held = [rows[cut:]]
        if held:
            yield done(np.concatenate(held))

    return keyed.select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def _tiled(keyed: DataFrame, hot: int) -> DataFrame:
    """(mask, key, fp) with a key for each two tiles of buckets of more than ``hot`` fingerprints; every two members of such a bucket share one."""
    sizes = write_table(keyed.groupBy("mask", "key").count().where(F.col("count") > hot), "simhash-tiles")
    tiles = sizes.select("mask", "key", F.ceil(F.col("count") / hot).alias("tiles"))
    dealt = keyed.join(tiles, ["mask", "key"], "left").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    met = F.when(F.col("tiles").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    each = dealt.withColumn("other", F.explode(met))
    # two buckets under one hash would only be compared in vain
    pair = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    return each.select("mask", F.when(F.col("other").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints ``fp`` within ``radius`` bits."""
    first = _masks(list(range(64)), blocks, blocks - radius)
    pairs = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits")) for i, m in enumerate(first)])
    keyed = fps.select("fp", F.inline(pairs)).select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
    crowded = write_table(keyed.groupBy("mask", "key").count().where(F.col("count") > hot), "simhash-hot").select("mask", "key")
    if not crowded.isEmpty():
        second, ids = {}, len(first)
        for i, m in enumerate(first):
            own = _masks([b for b in range(64) if not m >> b & 1], 2 * radius, radius)
            second[i] = F.array(*[F.struct(F.lit(ids + k).alias("mask"), F.lit(_signed(m | x)).alias("bits")) for k, x in enumerate(own)])
            ids += len(own)
        finer = F.coalesce(*[F.when(F.col("mask") == i, x) for i, x in second.items()])
        again = keyed.join(crowded, ["mask", "key"], "left_semi").select("fp", F.inline(finer))
        again = write_table(again.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp"), "simhash-finer")
        keyed = keyed.join(crowded, ["mask", "key"], "left_anti").select("mask", "key", "fp").unionByName(_tiled(again, hot))
    return _edges(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp"), radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge.

    Alternating large-star and small-star steps, each a grouped minimum and a join, on written tables.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        mid = write_table(large.distinct(), "large-star")
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        nxt = write_table(small.where("u <> v").distinct(), "small-star")
        drop_table(now)
        drop_table(mid)
        now, before, seen = nxt, seen, state(nxt)
        if seen == before:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """Per row: doc_id, fp, component_id (smallest doc_id reachable)."""
    marked = write_table(fingerprints(docs), "fingerprints")
    return marked.join(classes(marked, radius, blocks, hot), "fp").select("doc_id", "fp", "component_id")


def classes(marked: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``marked`` (fp, doc_id)."""
    least = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp")
    root = write_table(components(links(least.select("fp"), radius, blocks, hot)), "components")
    linked = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.join(ids, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The columns of ``docs``, one row of each component: the smallest doc_id, nulls last; of repeated rows one."""
    columns = docs.columns
    marked = docs.withColumn("__near_row", F.monotonically_increasing_id())
    fp = arrow_udf(_fingerprints, "long")(as_bytes())
    marked = write_table(marked.withColumn("__near_fp", fp), "marked")
    thin = marked.select(F.col("__near_fp").alias("fp"), "doc_id", F.col("__near_row").alias("row"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    chosen = thin.join(classes(thin.select("fp", "doc_id"), radius).select("fp", "root"), "fp").groupBy("root").agg(F.min(first).alias("first"))
    return marked.join(chosen.select(F.col("first.row").alias("__near_row")), "__near_row", "left_semi").select(*columns)
