"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are packed, where they are read, into blocks of bounded size: one sorted list of (value, vector) per component. For a query a list holds
contributions (query component times value), and is read from the end where they are large. All lists are read so far that their
frontiers stand at one level of contribution, and the level sinks step by step: a list with a large query component is read
deeper, one of a zero component not at all. A vector has the sum of what was read of it so far; each unread contribution is at most the level and at
least the far end of its list. When few vectors have an upper bound that reaches the k best lower bounds, reading stops, and those are scored.

Queries come in batches. A batch first meets one block, which gives each query a score that it must reach: of the other blocks
only what can reach it is kept, so there reading stops early. A task holds one block and ``QUERY_GROUP`` queries at
most. Blocks are shuffled once for each such group, queries once for each block.

Defined cases: a vector that is null, empty, or holds null or non-finite components takes no part, nor does a row without vec_id. A
component whose floor(scale * x) is beyond a long counts as the nearest long, and so does a score; sums before that are exact whatever their size.
Vectors of different lengths are never compared. Ties go to the smaller vec_id. Repeated rows are candidates once each; queries with the same
vec_id are one query, which gets the k best of all their scores. A query never meets a row of its own vec_id. An empty table gives no rows; other
columns aren't read.
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

K = 5
VECTOR_BLOCK = 8192
QUERY_BATCH = 128
QUERY_GROUP = 64 * QUERY_BATCH
SCALE = 256
STEPS = 16  # a list can be stopped at so many places
DEPTHS = (0.125, 0.5, 0.625, 0.75, 0.875, 1.0)  # shares of the lists at which the bounds are looked at
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EDGE = 2.0**63 * (1 - 2.0**-40)
BLOCK = "part int, seq int, n int, dims int, ids binary, places binary, vectors binary"
FOUND = "batch long, block long, query_id long, vec_id long, score long, kth long, entries_read long, entries long"


def finite(v: str) -> Column:
    """Whether an array of doubles has components, and all of them are finite."""
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, scale: int = SCALE, vector_col: str = "embedding", id_col: str = "vec_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for rows that take part; ``keep``: columns besides, with names."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *keep)
    rows = rows.where(F.col("vec_id").isNotNull() & finite("v"))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"), *[c for c in rows.columns if c not in ("vec_id", "v")])


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest of 16, 32 or 64 bits that holds them all."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _wide(raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // int(np.prod(shape))}").reshape(shape).astype(np.int64)


def packed(rows: DataFrame, most: int, lists: bool = True) -> DataFrame:
    """``rows`` in blocks of at most ``most`` vectors of one length each, made without a shuffle; ``lists``: with the order of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        waiting: dict[int, tuple[list, list]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal seq
            ids, vectors = waiting.pop(dims)
            x = np.concatenate(vectors).reshape(len(ids), dims)
            places = np.argsort(x, axis=0, kind="stable").T if lists else np.zeros(0, np.int64)
            row = [part, seq, len(ids), dims, np.array(ids, np.int64).tobytes(), _narrow(places).tobytes(), _narrow(x).tobytes()]
            seq += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=kinds)

        names = [c.split()[0] for c in BLOCK.split(", ")]
        kinds = pa.schema([(n, pa.int32() if n in ("part", "seq", "n", "dims") else pa.binary()) for n in names])
        for batch in batches:
            flat, at = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]
            for i, own in enumerate(batch.column(0).to_pylist()):
                dims = int(at[i + 1] - at[i])
                ids, vectors = waiting.setdefault(dims, ([], []))
                ids.append(own)
                vectors.append(flat[at[i] : at[i + 1]].astype(np.int64))
                if len(ids) == most:
                    yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    return rows.mapInArrow(run, BLOCK)


def numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Packed blocks with a gapless number: those of earlier tasks come first. Only a count for each task is ordered."""
    per_task = blocks.groupBy("part").agg(F.count("*").alias("here"))
    before = per_task.select("part", F.coalesce(F.sum("here").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return blocks.join(before, "part").withColumn(name, F.col("before") + F.col("seq")).drop("part", "seq", "before")


class Lists:
    """One block: its vectors, and for each component the order of them by it, cut into ``STEPS`` cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray):
        self.ids, self.vectors, self.places = ids, vectors, np.ascontiguousarray(places, np.intp)
        self.n, self.dims = vectors.shape
        self.cuts = np.linspace(0, self.n, STEPS + 1).round().astype(np.int64)
        self.values = np.take_along_axis(np.ascontiguousarray(vectors.T), self.places, axis=1).astype(float)
        self.good, self.bad = self.values[:, np.maximum(self.cuts[:0:-1] - 1, 0)], self.values[:, np.minimum(self.cuts[:-1], self.n - 1)]
        self.largest = max(1.0, float(np.abs(self.values).max(initial=0)))

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Lists:
        return cls(ids, vectors, np.argsort(vectors, axis=0, kind="stable").T)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products with some vectors, the nearest long where they are beyond."""
        if self.largest * float(np.abs(q.astype(float)).sum()) < 1 << 62:
            return self.vectors[rows] @ q
        mine = [int(a) for a in q]
        return np.array([max(LEAST, min(MOST, sum(a * int(b) for a, b in zip(mine, v)))) for v in self.vectors[rows]], np.int64)

    def candidates(self, q: np.ndarray, k: int, least: float, own: np.ndarray) -> tuple[np.ndarray, int]:
        """The vectors that may be among the k best of a query and reach ``least``, with all ties, and how many list entries it read.

        ``own``: the vectors that don't count."""
        n, used = self.n, np.flatnonzero(q)  # a list of a zero component is never read
        if n <= max(4 * k, STEPS) or not len(used):
            return np.setdiff1d(np.arange(n), own), 0
        weight, up = q[used].astype(float), q[used] > 0
        slack = float(np.abs(weight).sum()) * self.largest * 2.0**-44  # more than double sums can be off by
        slack = slack if slack > 2.0**8 else 0.0  # below, they are exact
        heads = np.where(up[:, None], self.good[used], self.bad[used]) * weight[:, None]  # what the cells begin with, good ones first
        levels = np.sort(heads, axis=None)[::-1]
        far = np.where(up, self.values[used, 0], self.values[used, -1]) * weight
        blind = not np.isfinite(least)  # lower bounds are of use only where no score is known that must be reached
        known, seen, missed = np.zeros(n), np.zeros(n, np.int64), np.full(n, far.sum())
        depth, read, few = np.zeros(len(used), np.int64), 0, max(4 * k, n // 16)
        for share in DEPTHS:
            level = levels[min(len(levels) - 1, int(share * len(levels)))] if share < 1 else -np.inf
            deeper = np.maximum(depth, (heads > level).sum(axis=1))
            start = np.where(up, self.cuts[STEPS - deeper], self.cuts[depth])
            end = np.where(up, self.cuts[STEPS - depth], self.cuts[deeper])
            spans = [(d, slice(i, j)) for d, i, j in zip(used, start, end)]
            entries = np.concatenate([self.places[d, s] for d, s in spans])
            known += np.bincount(entries, np.concatenate([self.values[d, s] * w for (d, s), w in zip(spans, weight)]), n)
            seen += np.bincount(entries, minlength=n)
            if blind:
                missed -= np.bincount(entries, np.repeat(far, end - start), n)
            depth, read = deeper, read + len(entries)
            unread = depth < STEPS
            frontier = heads[unread, depth[unread]].max() if unread.any() else 0.0
            upper, bar = known + frontier * (len(used) - seen), least
            if blind:
                lower = known + missed
                lower[own] = -np.inf
                bar = float(np.partition(lower, n - k)[n - k])
            bar -= 2 * slack
            may = upper >= (-np.inf if bar < -EDGE else min(bar, EDGE))  # beyond a long all scores are alike
            if np.count_nonzero(may) <= few or not unread.any():
                break
        may[own] = False
        return np.flatnonzero(may), read

    def top(self, own_id: int, q: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(vectors, scores, entries read) of a query: the k best that score ``least`` or more, best first."""
        # as a double that isn't above it
        rows, read = self.candidates(q, k, -np.inf if least is None else float(least - (abs(least) >> 52)), np.flatnonzero(self.ids == own_id))
        score = self.scores(q, rows)
        keep = score >= (LEAST if least is None else least)
        rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], np.invert(score)))[:k]  # ~score is -score - 1, which no long overflows
        return rows[best], score[best], read


def _meet(blocks: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """What each batch finds in the block of the same number. ``batches``: batch, block, group, n, dims, ids, vectors, reach (query id -> score, or null)."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = pa.schema([(n, pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for b in left.to_pylist():
            shape = (b["n"], b["dims"])
            block = Lists(np.frombuffer(b["ids"], "<i8"), _wide(b["vectors"], shape), _wide(b["places"], shape[::-1]))
            for row in range(right.num_rows):
                some = {c: right.column(c)[row].as_py() for c in right.column_names}
                if some["dims"] != b["dims"]:
                    continue
                reach = dict(some["reach"] or ())
                for i, q in zip(np.frombuffer(some["ids"], "<i8").tolist(), _wide(some["vectors"], (some["n"], some["dims"]))):
                    rows, score, read = block.top(i, q, k, reach.get(i))
                    kth = int(score[k - 1]) if len(score) == k else None
                    # what was read stands on the first row of a pair, and counts though nothing was found
                    found = list(zip(block.ids[rows].tolist(), score.tolist())) or [(None, None)]
                    for r, (vec_id, x) in enumerate(found):
                        for column, value in zip(out, (some["batch"], some["block"], i, vec_id, x, kth, 0 if r else read, 0 if r else block.n * block.dims)):
                            column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=kinds)

    return blocks.groupBy("block", "group").cogroup(batches.groupBy("block", "group")).applyInArrow(run, FOUND)


def found_in_blocks(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, query_batch: int = QUERY_BATCH, vector_block: int = VECTOR_BLOCK, query_group: int = QUERY_GROUP) -> DataFrame:
    """Up to k rows for each query and block, as a written table; entries_read of entries were read (on the first row of each pair)."""
    rows = quantised(vectors, scale)
    blocks = write_table(packed(rows, vector_block), "blocks")
    asked = write_table(packed(rows.where(is_query).distinct(), query_batch, lists=False), "queries")
    n, batches = blocks.count(), numbered(asked, "batch").drop("places")
    groups = max(1, -(-asked.count() * query_batch // query_group))
    batches = batches.withColumn("group", F.col("batch") % groups)
    all_blocks = numbered(blocks, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    home = F.col("batch") % max(1, n)
    first = write_table(_meet(all_blocks, batches.withColumn("block", home).withColumn("reach", F.lit(None).cast("map<long,long>")), k), "first")
    # the score that a query must reach elsewhere: its k-th in the first block
    reach = first.groupBy("batch", "query_id").agg(F.max("kth").alias("kth")).groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("reach"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long")), lambda b: b != home)
    rest = _meet(all_blocks, batches.join(reach, "batch", "left").withColumn("block", F.explode(others)), k)
    found = write_table(first.unionByName(rest), "found")
    for used in (blocks, asked, first):
        drop_table(used)
    return found


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for each row where ``is_query`` (a condition on vec_id) holds."""
    near = found_in_blocks(vectors, is_query, k, scale, **sizes).where("vec_id is not null")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_read(found: DataFrame) -> DataFrame:
    """One row: the share of the list entries that :func:`found_in_blocks` read."""
    return found.agg((F.sum("entries_read") / F.sum("entries")).alias("share_read"))
