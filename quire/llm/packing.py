"""Vector best-fit packing of documents into sequences.

An item has three sizes: its tokens, one document, and its attention cost (length squared). A bin takes it
only if every residual capacity allows; of the bins that do, the one wins whose residual vector,
capacity-scaled and weighted, is smallest after the item is in (``norm``) or points most along the
item (``dot``). Items go in from the longest down.

Distribution: items are dealt by a hash of their document and text into groups of about ``group_items``,
each packed on its own: the number of groups follows the number of documents, no group is hot, and at most a few bins of
each group stay part-filled. Bins of equal residual are one state with a count, so an item is scored
against distinct residuals, which the capacities bound.

Defined cases: null or empty text gives the end token alone. Null ids are packed like any others, and stay null; ids keep all of their 64 bits
beside them. Repeated rows are packed once each. A long text becomes full pieces, which need no choice, and one shorter first piece. Items of one
length go in by hash, id and piece; of bins that score the same the one whose residual came up first wins. An empty table gives no pieces. Only ``doc_id``
and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import as_bytes, write_table
from quire.llm.tokens import tokenizer

MAX_TOKENS = 1024
MAX_DOCUMENTS = 256  # binds where documents hold fewer than four tokens on average
MAX_ATTENTION = MAX_TOKENS * MAX_TOKENS  # what a full piece costs, so the least that takes every piece
WEIGHTS = (1.0, 1.0, 1.0)
GROUP_ITEMS = 16384


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: full ones after a first that takes what is left over."""
    head = n % most
    return ([head] if head else []) + [most] * (n // most)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, item[, ids]) of every document, from its whole text."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, own_ids in zip(batch.column(0).to_pylist(), encoder.encode_array(batch.column(1))):
                ids = own_ids.tobytes() + end
                at, key = 0, zlib.crc32(ids, zlib.crc32(str(doc_id).encode()))
                for i, n in enumerate(cut_lengths(len(ids) // 4, max_tokens)):
                    own = ids[4 * at : 4 * (at + n)]
                    for column, x in zip(rows, (doc_id, i, at, n, zlib.crc32(own), key, own)):
                        column.append(x)
                    at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, item long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCUMENTS, MAX_ATTENTION),
             weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, items given from the longest down."""
    room = np.array(capacity, np.int64)
    if len(lengths) and (lengths[0] > capacity[0] or lengths[0] ** 2 > capacity[2] or capacity[1] < 1):
        raise ValueError("an item exceeds the capacity of an empty bin")
    scale = np.sqrt(np.array(weights)) / room
    states = np.zeros((64, 3), np.int64)  # distinct residuals; rows from `used` on are free
    used, where, bins, residual = 0, {}, [], []  # where: residual -> row; bins: row -> open bins
    out, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        item = np.array([n, 1, n * n])
        after = states[:used] - item
        fits = (after >= 0).all(axis=1)
        if fits.any():
            rows = np.flatnonzero(fits)
            left = after[rows] * scale
            score = (left**2).sum(axis=1) if rule == "norm" else -((states[rows] * scale) @ (item * scale))
            row = int(rows[np.argmin(score)])
            own, rest = bins[row].pop(), states[row] - item
            if not bins[row]:  # the last of this residual: the last row takes its place
                del where[tuple(states[row].tolist())]
                used -= 1
                states[row], bins[row] = states[used], bins[used]
                if row != used:
                    where[tuple(states[row].tolist())] = row
                bins.pop()
        else:
            own, rest = len(residual), room - item
            residual.append(0)
        out[i], offset[i] = own, residual[own]
        residual[own] += n
        if rest[0] >= least and rest[1] >= 1:
            key = tuple(rest.tolist())
            if key in where:
                bins[where[key]].append(own)
            else:
                if used == len(states):
                    states = np.concatenate([states, np.zeros_like(states)])
                states[used], where[key] = rest, used
                bins.append([own])
                used += 1
    return out, offset


def pack(items: DataFrame, groups: int, capacity: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCUMENTS, MAX_ATTENTION),
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """``items`` (with ``length``, ``item``, doc_id, piece) plus sequence_id and offset.

    ``groups``: how many bin groups the items are dealt to. sequence_id is group << 32 | bin.
    """
    schema = items.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("__group")
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("item", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        bins, offset = best_fit(rows["length"].to_numpy().astype(np.int64), capacity, weights, rule)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offset))

    dealt = items.withColumn("__group", F.pmod(F.xxhash64("item", "doc_id"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCUMENTS, MAX_ATTENTION),
                   weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group_items: int = GROUP_ITEMS, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset, and its ids if asked for.

    A full piece fills a sequence of its own, so only first pieces shorter than that, one of each document
    at most, have to be packed; their number sets the number of groups. Ids don't take part in that: they come back by a number of the piece.
    """
    made = write_table(pieces(docs, tokenizer_path, end_id, capacity[0], with_ids).withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < capacity[0]
    groups = max(1, -(-made.where(part).count() // group_items))
    full = made.where(~part).select("*", (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = pack(made.where(part).drop("ids"), groups, capacity, weights, rule)
    if with_ids:
        packed = packed.join(made.where(part).select("__piece", "ids"), "__piece")
    return full.unionByName(packed).drop("item", "__piece")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed ``with_ids``: the packed sequences themselves."""
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
