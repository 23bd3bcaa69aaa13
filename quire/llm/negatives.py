"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every vector is rotated at random (signs and Hadamard steps) and coded by the signs of its components; beside the code stands how far the vector
goes along it (the alignment) and how long the rest is. The rest is rotated and coded again, ``LEVELS`` times in all: one code alone
leaves 0.6 of the length, five leave 0.08. A query meets the codes by popcounts over the bit planes of its quantised rotations. That
gives an estimate of the inner product; what it can be off by is bounded by Cauchy-Schwarz, the length of the rest times the part of the query
that is not along the code, plus the query's own rounding. No interval ever misses the true value, so what can't be among the k best by its interval
is left out for good, level by level. Who is left is scored in integers.

1. Vectors are packed into blocks with their codes where they are read; anchors into batches.
2. Positives: each anchor's ``positives`` best rows of its own label.
3. Negatives: for each positive the k best rows of other labels that score between ``low_share`` of the positive's score and that score.

Both searches look for the best rows of each *want*, a range of scores. A batch meets one block first; of the other blocks only what
reaches the k-th score found there is kept. A task holds one block and ``topk.QUERY_GROUP`` anchors at most.

Defined cases: a row with a null label, id or vector, an empty vector, or a null or non-finite component takes no part. A component beyond
a long counts as the nearest long, and so does a score. Vectors of different lengths are never compared. Higher scores come first, ties go
to the smaller vec_id. Repeated rows count once each as positives and negatives, and as one anchor. A row never meets rows of its own vec_id. Where the
positive's score is
negative, no row can lie in the range. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import drop_table, write_table
from quire.llm.topk import EDGE, LEAST, MOST, QUERY_BATCH, QUERY_GROUP, SCALE, VECTOR_BLOCK, _narrow, _wide, numbered, quantised

K = 5
POSITIVES = 5
LOW_SHARE = (4, 5)  # numerator and denominator
LEVELS = 5
PLANES = 8
ROUNDS = 3
SLACK = 1e-9  # of the product of both lengths: more than doubles can be off by
BLOCK = "part int, seq int, n int, dims int, ids binary, labels binary, vectors binary, codes binary, along binary, rest binary, length binary"
ANCHORS = "part int, seq int, n int, dims int, ids binary, labels binary, vectors binary"
FOUND = "batch long, place int, anchor_id long, want int, vec_id long, score long, scored long, met long"


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """Rows of ``x``, whose length is a power of two, turned by a rotation that only this length and ``level`` fix."""
    n, size = x.shape
    for turn in np.random.default_rng((size, level)).choice([-1.0, 1.0], (ROUNDS, size)):
        x, half = x * turn, 1
        while half < size:
            pairs = x.reshape(n, -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        x = x / np.sqrt(size)
    return x


def padded(v: np.ndarray) -> np.ndarray:
    """Rows of ``v`` as doubles of 64, 128, 256, ... components."""
    n, dims = v.shape
    x = np.zeros((n, max(64, 1 << (dims - 1).bit_length())))
    x[:, :dims] = v
    return x


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes [level, row, word], along [level, row], rest [level, row], length [row]) of integer vectors."""
    rest = padded(v)
    size, length = rest.shape[1], np.linalg.norm(rest, axis=1)
    codes, along, left = [], [], []
    for level in range(LEVELS):
        rest = rotated(rest, level)
        up = rest > 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
        along.append(np.abs(rest).sum(axis=1) / np.sqrt(size))
        rest = rest - np.where(up, 1.0, -1.0) * (along[-1] / np.sqrt(size))[:, None]
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes), np.stack(along), np.stack(left), length


def _ones(words: np.ndarray) -> np.ndarray:
    """The ones in each row of words."""
    counts = np.bitwise_count(words)
    return counts[:, 0].astype(np.int32) if counts.shape[1] == 1 else counts.sum(axis=1, dtype=np.int32)


class Planes:
    """A rotated query as bit planes: steps above its lowest component."""

    def __init__(self, x: np.ndarray):
        self.low, self.length, self.size = float(x.min()), float(np.linalg.norm(x)), len(x)
        self.step = (float(x.max()) - self.low) / ((1 << PLANES) - 1)
        u = np.rint((x - self.low) / self.step).astype(np.int64) if self.step > 0 else np.zeros(self.size, np.int64)
        self.planes = np.packbits((u >> np.arange(PLANES)[:, None] & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)
        known = self.low + self.step * u
        self.total, self.off = float(known.sum()), float(np.linalg.norm(x - known))

    def along(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of the quantised query with the unit vectors that codes [row, word] stand for."""
        weighted = np.zeros(len(codes), np.int32)
        for i, plane in enumerate(self.planes):
            weighted += _ones(codes & plane) << i
        ones = _ones(codes)
        return (2 * (self.low * ones + self.step * weighted) - self.total) / np.sqrt(self.size)


def asked_planes(queries: np.ndarray) -> list[list[Planes]]:
    """For each query its planes at each level."""
    x, out = padded(queries), [[] for _ in queries]
    for level in range(LEVELS):
        x = rotated(x, level)
        for planes, q in zip(out, x):
            planes.append(Planes(q))
    return out


class Block:
    """The vectors of a block with their codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.codes, self.along, self.rest, self.length = coded
        self.largest = max(1.0, float(np.abs(vectors.astype(float)).max(initial=0)))

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products with some vectors, the nearest long where they are beyond."""
        if self.largest * float(np.abs(q.astype(float)).sum()) < 1 << 62:
            return self.vectors[rows] @ q
        mine = [int(a) for a in q]
        return np.array([max(LEAST, min(MOST, sum(a * int(b) for a, b in zip(mine, v)))) for v in self.vectors[rows]], np.int64)

    def intervals(self, planes: list[Planes], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lower and upper bounds of the scores of ``rows``, closer with each level; the receiver sends which of them are left."""
        seen, off = np.zeros(len(rows)), np.zeros(len(rows))
        for level, query in enumerate(planes):
            dot, along = query.along(self.codes[level, rows]), self.along[level, rows]
            seen, off = seen + along * dot, off + along * query.off
            across = np.sqrt(np.maximum(query.length**2 - np.maximum(np.abs(dot) - query.off, 0) ** 2, 0))
            reach = self.rest[level, rows] * across + off + SLACK * query.length * self.length[rows]
            left = yield seen - reach, seen + reach
            rows, seen, off = rows[left], seen[left], off[left]

    def best(self, q: np.ndarray, planes: list[Planes], rows: np.ndarray, wants: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each want (low, high) the k best of ``rows`` that score within, best first, as (rows, scores); and how many rows were scored."""
        if len(rows):
            bounds = self.intervals(planes, rows)
            low, high = next(bounds)
            while True:
                may = np.zeros(len(rows), bool)
                for least, most in wants:
                    bar, most = _below(least), _above(most)
                    sure = low[high <= most]
                    if len(sure) >= k:  # as many as are wanted reach this
                        bar = max(bar, min(float(np.partition(sure, len(sure) - k)[len(sure) - k]), _below(MOST)))
                    may |= (high >= (bar if bar > -EDGE else -np.inf)) & (low <= most)  # beyond a long all scores are alike
                rows, left = rows[may], np.flatnonzero(may)
                try:
                    low, high = bounds.send(left)
                except StopIteration:
                    break
        score = self.scores(q, rows)
        out = []
        for least, most in wants:
            fits = np.flatnonzero((score >= least) & (score <= most))
            order = fits[np.lexsort((self.ids[rows[fits]], np.invert(score[fits])))[:k]]  # ~score falls as score rises, without overflow
            out.append((rows[order], score[order]))
        return out, len(rows)


def _below(x: int) -> float:
    """A double that isn't above a long."""
    return float(x - (abs(x) >> 52) - 1)


def _above(x: int) -> float:
    return float(x + (abs(x) >> 52) + 1) if x < MOST else np.inf


def _packed(rows: DataFrame, most: int, coded: bool) -> DataFrame:
    """``rows`` (vec_id, v, label) in blocks of at most ``most`` vectors of one length each, made without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        waiting: dict[int, tuple[list, list, list]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal seq
            ids, labels, vectors = waiting.pop(dims)
            x = np.concatenate(vectors).reshape(len(ids), dims)
            row = [part, seq, len(ids), dims, np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), _narrow(x).tobytes()]
            row += [a.tobytes() for a in encode(x)] if coded else []
            seq += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=kinds)

        names = [c.split()[0] for c in (BLOCK if coded else ANCHORS).split(", ")]
        kinds = pa.schema([(n, pa.int32() if n in ("part", "seq", "n", "dims") else pa.binary()) for n in names])
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            for i, (own, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                dims = int(at[i + 1] - at[i])
                ids, labels, vectors = waiting.setdefault(dims, ([], [], []))
                ids.append(own)
                labels.append(label)
                vectors.append(flat[at[i] : at[i + 1]].astype(np.int64))
                if len(ids) == most:
                    yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    return rows.mapInArrow(run, BLOCK if coded else ANCHORS)


def _meet(blocks: DataFrame, batches: DataFrame, k: int, same: bool) -> DataFrame:
    """What each batch finds in the block of its number. ``batches``: batch, block, group, n, dims, ids, labels, vectors, wants (place, want, low, high)."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = pa.schema([(n, pa.int32() if n in ("place", "want") else pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for b in left.to_pylist():
            n, dims = b["n"], b["dims"]
            coded = (np.frombuffer(b["codes"], np.uint64).reshape(LEVELS, n, -1), *(np.frombuffer(b[c]).reshape(LEVELS, n) for c in ("along", "rest")), np.frombuffer(b["length"]))
            block = Block(np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8"), _wide(b["vectors"], (n, dims)), coded)
            for row in range(right.num_rows):
                some = {c: right.column(c)[row].as_py() for c in right.column_names}
                if some["dims"] != dims:
                    continue
                ids, labels, q = np.frombuffer(some["ids"], "<i8"), np.frombuffer(some["labels"], "<i8"), _wide(some["vectors"], (some["n"], dims))
                planes, wants = asked_planes(q), {}
                for w in some["wants"]:
                    wants.setdefault(w["place"], []).append((w["want"], w["low"], w["high"]))
                for place, mine in wants.items():
                    rows = np.flatnonzero(((block.labels == labels[place]) == same) & (block.ids != ids[place]))
                    best, scored = block.best(q[place], planes[place], rows, [(low, high) for _, low, high in mine], k)
                    met = len(rows)
                    for (want, *_), (at, score) in zip(mine, best):
                        # what was scored stands on the first row of an anchor and a block, and counts though nothing was found
                        for vec_id, x in zip(block.ids[at].tolist(), score.tolist()) if len(at) else [(None, None)]:
                            for column, value in zip(out, (some["batch"], place, int(ids[place]), want, vec_id, x, scored, met)):
                                column.append(value)
                            scored = met = 0
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds.types)], schema=kinds)

    return blocks.groupBy("block", "group").cogroup(batches.groupBy("block", "group")).applyInArrow(run, FOUND)


def _search(blocks: DataFrame, batches: DataFrame, wants: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """(batch, place, want, rank, vec_id, score, scored, met) of the k best for each want (batch, place, want, low, high), a written table; rows without rank only count."""

    def asked(w: DataFrame) -> DataFrame:
        return batches.join(w.groupBy("batch").agg(F.collect_list(F.struct("place", "want", "low", "high")).alias("wants")), "batch")

    home = F.col("batch") % max(1, n)
    first = write_table(_meet(blocks, asked(wants).withColumn("block", home), k, same), "first")
    kth = first.groupBy("batch", "place", "want").agg(F.count("score").alias("c"), F.min("score").alias("kth")).where(F.col("c") == k).drop("c")
    raised = wants.join(kth, ["batch", "place", "want"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long")), lambda b: b != home)
    rest = _meet(blocks, asked(raised).withColumn("block", F.explode(others)), k, same)
    rank = F.row_number().over(W.partitionBy("batch", "place", "want").orderBy(F.desc_nulls_last("score"), "vec_id"))
    found = first.unionByName(rest).withColumn("rank", rank)
    kept = found.where((F.col("rank") <= k) | (F.col("met") > 0)).withColumn("rank", F.when((F.col("rank") <= k) & F.col("vec_id").isNotNull(), F.col("rank")))
    done = write_table(kept, "found")
    drop_table(first)
    return done


def mine(vectors: DataFrame, is_anchor: Column, k: int = K, positives: int = POSITIVES, low_share: tuple[int, int] = LOW_SHARE, scale: int = SCALE,
         label_col: str = "label", anchor_batch: int = QUERY_BATCH, vector_block: int = VECTOR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), and the found rows of both searches with what they scored.

    ``is_anchor``: a condition on vec_id."""
    rows = quantised(vectors.where(F.col(label_col).isNotNull()), scale, keep=(F.col(label_col).cast("long").alias("label"),))
    blocks = write_table(_packed(rows, vector_block, True), "code-blocks")
    asked = write_table(_packed(rows.where(is_anchor).distinct(), anchor_batch, False), "anchors")
    n, batches = blocks.count(), numbered(asked, "batch")
    groups = max(1, -(-asked.count() * anchor_batch // QUERY_GROUP))
    batches = write_table(batches.withColumn("group", F.col("batch") % groups), "anchor-batches")
    all_blocks = numbered(blocks, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))

    every = batches.select("batch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"), F.lit(0).alias("want"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = _search(all_blocks, batches, every, n, positives, True)
    pairs = near.where("rank is not null").select("batch", "place", "anchor_id", F.col("rank").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    over, under = low_share
    # the least long s with under * s >= over * positive_score, without overflow; a negative score has no range
    p = F.col("positive_score")
    least = F.expr(f"(positive_score div {under}) * {over} + ({over} * (positive_score % {under}) + {under - 1}) div {under}")
    ranges = pairs.where(p >= 0).select("batch", "place", "want", least.alias("low"), p.alias("high"))
    hard = _search(all_blocks, batches, ranges, n, k, False)
    named = hard.where("rank is not null").select("batch", "place", "want", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    result = named.join(pairs, ["batch", "place", "want"])
    for used in (blocks, asked):
        drop_table(used)
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), near.unionByName(hard)


def share_scored(found: DataFrame) -> DataFrame:
    """One row: of the rows that the intervals were looked at for, the share that had to be scored."""
    return found.agg((F.sum("scored") / F.sum("met")).alias("share_scored"))
