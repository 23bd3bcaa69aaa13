"""Substring dedup: a compacted de Bruijn graph of word k-mers.

Nodes are (k-1)-word sequences, edges the k-word windows of the documents. Windows that follow each
other and share one minimizer (the longest, then smallest-hashed, run of three words inside them) form a path
of at most ``k - 2`` edges, found while a document is read, so a path travels as one row instead of
one row per edge.

1. Paths: (minimizer, content, doc, place) of every document, one pass over the whole texts.
2. A minimizer seen in one document only is dropped: no window over it repeats elsewhere. Where all
   paths over a minimizer are equal the graph doesn't branch: the path is compacted, and a join with the
   smallest document id of the minimizer settles all of its windows at once.
3. Where paths over one minimizer differ (a branch: the edge of a shared passage), they are expanded
   into their k-mer edges, from the text at the source coordinates, and a second join settles each edge.
4. The coordinates, with a tag of the text, bring the windows back to their documents.

Equal windows have the same minimizer, so both are in one group of step 2 whatever surrounds them: the
result is exact up to 128 bits of hash. A hot passage is a key of partial aggregates and of joins that
adaptive execution splits; it is never collected.

Defined cases: null or empty text has no words. Rows with a null ``doc_id`` are kept whole and remove
nothing. Repeated rows (one doc_id) don't remove each other. Extra columns pass through untouched.
Very long texts are read whole, an empty table stays empty; of equal windows that of the smallest doc_id stays, ties within one document both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.hashing import BYTE, ODD, SPACE, Powers, spans, word_bounds
from quire.llm.shared import as_bytes, data, drop_table, mix64, offsets, slices, write_table

WINDOW = 13
GRAM = 3
_SLICE = 1 << 20
_WORDS = 1 << 18  # words looked at together; a longer document goes in overlapping parts
_BYTES, _CONTENT = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
_WINDOWS = (Powers(0xE7037ED1A0B428DB), Powers(0x8EBC6AF09C88C6E3))


def _hashed(text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word lengths, and the first word of each document (one more at the end)."""
    if len(text) <= 2 * _SLICE or len(off) > 2:
        start, end = word_bounds(text, off[:-1])
        return spans(BYTE[text], start, end, _BYTES), end - start, np.searchsorted(start, off)
    hashes, sizes, at = [], [], 0
    spaces = np.flatnonzero(SPACE[text])
    while at < len(text):
        k = np.searchsorted(spaces, at + _SLICE)
        to = int(spaces[k]) if k < len(spaces) else len(text)
        start, end = word_bounds(text[at:to], np.zeros(1, np.int64))
        hashes.append(spans(BYTE[text[at:to]], start, end, _BYTES))
        sizes.append(end - start)
        at = to
    h = np.concatenate(hashes)
    return h, np.concatenate(sizes), np.array([0, len(h)])


def _paths(h: np.ndarray, size: np.ndarray, first: np.ndarray, k: int):
    """(document, first window, windows, minimizer, content) of the paths in these words."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    gram = mix64(h[:-2] * ODD + mix64(h[1:-1] + np.uint64(1)) + mix64(h[2:] * np.uint64(3)))
    long = np.minimum(size[:-2] + size[1:-1] + size[2:], 16).astype(np.uint64)
    key = (np.uint64(63) - long) << np.uint64(58) | gram >> np.uint64(30) << np.uint64(24) | np.arange(n - 2, dtype=np.uint64)
    least, reach, want = key, 1, k - GRAM + 1  # the least key of `want` grams in a row, by doubling
    while reach * 2 <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < want:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    if not len(window):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.r_[True, (np.diff(window) > 1) | (np.diff(at[window]) != 0)]
    begin = window[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(window)])
    return doc[begin], begin, count, gram[at[begin]], spans(h, begin, begin + count + k - 1, _CONTENT)


def _documents(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, hashes, sizes, first words, words of the document before these) for parts of bounded size."""
    raw, off = data(text), offsets(text).astype(np.int64)
    for i, j in slices(text, _SLICE):
        h, size, first = _hashed(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        if j > i + 1 or len(h) <= _WORDS:
            yield i, h, size, first, 0
            continue
        for a in range(0, len(h), _WORDS):
            b = min(len(h), a + _WORDS + WINDOW - 1)
            yield i, h[a:b], size[a:b], np.array([0, b - a]), a


def _tags(text: pa.Array) -> np.ndarray:
    """24 bits of each text, so that rows of one doc_id with other texts stay apart."""
    return np.fromiter((zlib.crc32(t.as_buffer()) & 0xFFFFFF for t in text), np.int64, len(text))


def paths(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """For ``k`` from 3 to 17, (doc_id, place, gram, content) of every path; place: tag << 36 | first window << 4 | windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            tag = _tags(text)
            for i, h, size, first, before in _documents(text):
                doc, begin, count, gram, content = _paths(h, size, first, k)
                place = tag[i + doc] << 36 | (begin - first[doc] + before) << 4 | count
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(place), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))],
                                                 names=["doc_id", "place", "gram", "content"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), as_bytes().alias("text")).mapInArrow(run, "doc_id long, place long, gram long, content long")


def _edges(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, place, k1, k2): the k-mer edges of the ``places`` that each document row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, places = (batch.column(i) for i in range(3))
            for r in range(batch.num_rows):
                h = _hashed(*(lambda t: (t, np.array([0, len(t)])))(np.frombuffer(text[r].as_py(), np.uint8)))[0]
                place = np.asarray(places[r].as_py(), np.int64)
                count = place & 15
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(place >> 4 & 0xFFFFFFFF, count) + inner
                two = [pa.array(spans(h, at, at + k, p).view(np.int64)) for p in _WINDOWS]
                tag = int(place[0]) >> 36 if len(place) else 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[r].as_py(), np.int64)), pa.array(tag << 36 | at << 4 | 1), *two], names=["doc_id", "place", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, place long, k1 long, k2 long")


def _by_row(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id", F.shiftright("place", 36).alias("tag")).agg(F.collect_list("place").alias("places"))


def repeated_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, place) of every run of windows whose words also start in a document of a smaller id."""
    own = write_table(paths(docs, k), "paths")
    seen = own.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    shared = write_table(seen.where("lo < hi").select("gram", "lo", (F.col("c0") != F.col("c1")).alias("branch")), "shared-grams")
    found = write_table(own.join(shared, "gram").where("branch or doc_id > lo").select("doc_id", "place", "branch"), "found")
    drop_table(own)
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), as_bytes().alias("text"))
    text = text.withColumn("tag", F.crc32("text").bitwiseAND(0xFFFFFF))
    branching = _by_row(found.where("branch"))
    edges = write_table(_edges(text.join(branching, ["doc_id", "tag"]).select("doc_id", "text", "places"), k), "edges")
    # a table of its own: both sides of the join are then plain shuffles, which adaptive execution splits where one edge is hot
    first = write_table(edges.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "first-edges")
    single = edges.join(first, ["k1", "k2"]).where("doc_id > lo").select("doc_id", "place")
    windows = write_table(found.where("not branch").select("doc_id", "place").unionByName(single), "windows")
    for done in (shared, found, edges, first):
        drop_table(done)
    return windows


def cut(text: bytes, places: list[int] | None, k: int = WINDOW) -> tuple[bytes, int, int]:
    """The text without the words that the windows cover, and how many words it had and lost.

    A lost word goes with the white space up to the next word that stays or to the end.
    """
    if not places:
        return text, len(text.split()), 0
    start, _ = word_bounds(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))
    place = np.asarray(places, np.int64)
    begin = place >> 4 & 0xFFFFFFFF
    depth = np.zeros(len(start) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + (place & 15) + k - 1, -1)
    lost = np.cumsum(depth[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, lost, False].astype(np.int8)))
    edge = np.r_[start, len(text)]
    keep, at = [], 0
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
        keep.append(text[at : edge[a]])
        at = int(edge[b])
    return b"".join([*keep, text[at:]]), len(start), int(lost.sum())


def drop_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_words`` and ``n_removed`` (in place of columns so named).

    A text that loses nothing stays as it is, null too.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    windows = _by_row(repeated_windows(docs, k)).select(F.col("doc_id").alias("__w_id"), F.col("tag").alias("__w_tag"), F.col("places").alias("__w_places"))
    tag = F.crc32(as_bytes()).bitwiseAND(0xFFFFFF)
    marked = docs.select(*columns).join(windows, (F.col("doc_id").cast("long") == F.col("__w_id")) & (tag == F.col("__w_tag")), "left")
    rest = [c for c in columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(t or b"", p, k) for t, p in zip(batch.column("__w_text").to_pylist(), batch.column("__w_places").to_pylist())]
            text = pa.array([None if t is None else o[0] for o, t in zip(out, batch.column("__w_text").to_pylist())], pa.binary())
            counts = [pa.array([o[i] for o in out], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), text, *counts], names=[*rest, "__w_text", "n_words", "n_removed"])

    schema = marked.select(*rest).schema.add("__w_text", "binary").add("n_words", "long").add("n_removed", "long")
    done = marked.select(*rest, F.col("text").cast("binary").alias("__w_text"), "__w_places").mapInArrow(run, schema)
    return done.withColumn("text", F.col("__w_text").cast("string")).select(*columns, "n_words", "n_removed")
