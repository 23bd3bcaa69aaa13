"""SentencePiece encoding and decoding by a Unigram Viterbi over a double-array trie.

The pieces and scores of a SentencePiece model file are taken as log scores; the best segmentation of a
text maximises their sum. Spaces become the marker U+2581, a marker leads the text; a character that
no piece covers costs ``min score - 10`` and is written as its UTF-8 bytes where the model has byte
pieces, else as the unknown id. Decoding joins the pieces and bytes and turns markers into spaces.

No piece holds a marker after another character (checked as a model is loaded), so the best segmentation
of a text is that of its units: a unit begins at a marker that follows another character. Units are met
many times; each is segmented once per worker while it stays in a cache of bounded size, and those of
a group of texts are segmented together, position by position, in arrays.

Texts are taken as they are: a model with a normaliser of its own (a character map) is refused, one without (identity) needs none. The marker is the
only character that does not come back as it was: U+2581 in a text is read as a space, as the format has it.

Defined cases: a null text is an empty one and has no ids. Of segmentations of one score the one whose last piece begins earliest wins, then
likewise before it. Repeated rows get the same ids. A very long text is segmented unit by unit; a unit of any length in one piece. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the public model format
PENALTY = 10.0
CACHE_UNITS = 600_000
_SLICE = 1 << 20
_TOGETHER = 4096
_M = MARKER.encode()


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", raw[i : i + n])[0]
            i += n


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order, from a SentencePiece model file."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            out.append((own.get(1, b"").decode(), float(own.get(2, 0.0)), int(own.get(3, NORMAL))))
        elif number == 3 and dict(_fields(value)).get(2):
            raise ValueError(f"the normaliser of {path} is not read")
    return out


@dataclass
class Trie:
    """A double array over bytes: child of s by byte b is base[s] + b + 1 if check there is s; leaf[s] is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray

    @classmethod
    def build(cls, words: list[tuple[bytes, int]]) -> Trie:
        root: dict = {}
        for word, i in words:
            node = root
            for b in word:
                node = node.setdefault(b + 1, {})
            node[0] = i
        size = 1 << 16
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0], low = 1, 1
        todo = [(0, root)]
        while todo:
            at, node = todo.pop()
            if 0 in node:
                leaf[at] = node[0]
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            start = low
            while True:
                start = taken.find(0, start)
                if start < 0 or start + 300 > len(taken):
                    grow = len(taken)
                    taken.extend(bytes(grow))
                    base, leaf, check = np.r_[base, np.zeros(grow, np.int32)], np.r_[leaf, np.full(grow, -1, np.int32)], np.r_[check, np.full(grow, -1, np.int32)]
                    start = max(start, low)
                    continue
                b = start - codes[0]
                if b >= 0 and not any(taken[b + c] for c in codes):
                    break
                start += 1
            base[at] = b
            for c in codes:
                taken[b + c] = 1
                check[b + c] = at
                todo.append((b + c, node[c]))
            low = taken.find(0, low)
        return cls(base, check, leaf)

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of ``states``, -1 where there is none."""
        to = self.base[states] + byte + 1
        return np.where((to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == states), to, -1)


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]], cache: int = CACHE_UNITS):
        self.pieces = pieces
        matched = [(p.encode(), i) for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER) and p]
        scores = [s for _, s, t in pieces if t == NORMAL] or [0.0]
        least, most = min(scores), max(scores)
        self.scores = np.array([len(p.encode()) * most - 0.1 if t == USER else s for p, s, t in pieces])
        self.unknown_score = least - PENALTY
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.apart = not any(MARKER in p.lstrip(MARKER) for p, _, t in pieces if t in (NORMAL, USER))
        self.longest = max((len(b) for b, _ in matched), default=1)
        self.trie = Trie.build(matched)
        self.table = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode() if t != UNKNOWN else " ⁇ ".encode() for p, _, t in pieces]
        self.most, self.known = cache, {}

    def marked(self, text: str) -> bytes:
        return (MARKER + text.replace(" ", MARKER)).encode() if text else b""

    def _units(self, text: str) -> list[bytes]:
        whole = self.marked(text)
        if not self.apart:
            return [whole] if whole else []
        parts = whole.split(_M)
        out, lead = [], b""
        for p in parts[1:]:  # a run of markers stays with what follows it
            lead += _M
            if p:
                out.append(lead + p)
                lead = b""
        return out + ([lead] if lead else [])

    def viterbi(self, units: list[bytes]) -> list[np.ndarray]:
        """The ids of each unit; all are advanced together, position by position."""
        n, sizes = len(units), np.array([len(u) for u in units])
        long = int(sizes.max())
        text = np.zeros((n, long), np.int32)
        flat = np.frombuffer(b"".join(units), np.uint8)
        rows = np.repeat(np.arange(n), sizes)
        text[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        wide = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
        best = np.full((n, long + 1), -np.inf)
        best[:, 0] = 0.0
        back, piece = np.zeros((n, long + 1), np.int32), np.zeros((n, long + 1), np.int32)
        for s in range(long):
            at = np.flatnonzero((best[:, s] > -np.inf) & (s < sizes))
            if not len(at):
                continue
            single = np.zeros(n, bool)
            row, state = at, np.zeros(len(at), np.int32)
            for e in range(s + 1, min(long, s + self.longest) + 1):
                inside = e <= sizes[row]
                row, state = row[inside], state[inside]
                state = self.trie.step(state, text[row, e - 1])
                row, state = row[state >= 0], state[state >= 0]
                if not len(row):
                    break
                ids = self.trie.leaf[state]
                hit = ids >= 0
                r, ids = row[hit], ids[hit]
                single[r[wide[r, s] == e - s]] = True
                score = best[r, s] + self.scores[ids]
                better = score > best[r, e]
                r = r[better]
                best[r, e], back[r, e], piece[r, e] = score[better], s, ids[better]
            lone = at[~single[at]]
            e = s + wide[lone, s]
            score = best[lone, s] + self.unknown_score
            better = score > best[lone, e]
            lone, e = lone[better], e[better]
            best[lone, e], back[lone, e], piece[lone, e] = score[better], s, -1
        out = []
        back_, piece_, sizes_ = back.tolist(), piece.tolist(), sizes.tolist()
        for i in range(n):
            e, ids = sizes_[i], []
            b, p = back_[i], piece_[i]
            while e:
                s = b[e]
                if p[e] >= 0:
                    ids.append(p[e])
                elif self.byte_ids:
                    ids += [self.byte_ids[x] for x in reversed(units[i][s:e])]
                else:
                    ids.append(self.unknown)
                e = s
            out.append(np.array(ids[::-1], "<u4"))
        return out

    def _learn(self, units: set[bytes]) -> None:
        order = sorted(units, key=len)  # units of like length share their steps
        at = 0
        while at < len(order):
            n = max(1, min(_TOGETHER, (1 << 22) // len(order[min(at + _TOGETHER, len(order)) - 1])))
            part = order[at : at + n]
            self.known.update((u, ids.tobytes()) for u, ids in zip(part, self.viterbi(part)))
            at += n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(self._units(text))
            size += len(text)
            if size > _SLICE or i + 1 == len(texts):
                new = {u for units in held for u in units if u not in self.known}
                if len(self.known) + len(new) > self.most:  # begin anew with what this group needs
                    self.known = {}
                    new = {u for units in held for u in units}
                if new:
                    self._learn(new)
                get = self.known.__getitem__
                out += [b"".join(map(get, units)) for units in held]
                held, size = [], 0
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids that :meth:`encode` gives: byte pieces joined, markers to spaces, the leading one dropped."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        raw = raw.replace(_M, b" ")
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, Unigram] = {}


def _model(key: str, pieces: list) -> Unigram:
    """One model of each kind per worker process."""
    return _loaded.get(key) or _loaded.setdefault(key, Unigram(pieces))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, decoded_sha256) of every whole text."""
    pieces = load_pieces(model_path)  # the model file bounds what is sent to a task
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, pieces)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out = model.encode([t or "" for t in part.column(1).to_pylist()])
                n = [len(x) // 4 for x in out]
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))
                shas = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in out]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array(shas)],
                                                 names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    pieces = load_pieces(model_path)
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, pieces)
        for batch in batches:
            texts = [model.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
