"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, with a cache of units.

A unit is a stretch of text that the tokenizer's own rules can never join with its neighbours, so the
ids of a text are those of its units, one after the other. Texts are cut and their units looked up in
arrays; the library encodes a unit once per worker, as long as it stays in a cache of bounded size.
A unit is told by 64 bits of hash, its length and its first eight bytes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.hashing import BYTE, SPACE, Powers, spans, word_bounds
from quire.llm.shared import data, offsets, slices

CACHE_UNITS = 1_000_000
CACHE_IDS = 1 << 23
_SLICE = 1 << 19
_POWERS = Powers(0xC2B2AE3D27D4EB4F)
_BLANK = SPACE.copy()
_BLANK[0x1C:0x20] = True
#: fixed values: white space beyond ASCII, as UTF-8
_WIDE = [c.encode() for c in "\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"]
_TWO = np.array(sorted(int.from_bytes(c, "big") for c in _WIDE if len(c) == 2))
_THREE = np.array(sorted(int.from_bytes(c, "big") for c in _WIDE if len(c) == 3))
_TOGETHER = 2000  # units encoded in one text
_LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT[0x30:0x3A] = True
_KIND = np.where(_LETTER, 0, np.where(_DIGIT, 1, 2)).astype(np.uint8)
_KIND[[*range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 0
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0xC2, *range(0xCA, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_NO_LETTERS = np.array([int.from_bytes(c.encode(), "big") for c in "×÷İ"])  # between U+00C0 and U+024F: two signs, and one whose lower case is two characters


def space_bounds(text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units: documents, cut before each single space between two characters that are not white space."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    at = at[~_BLANK[text[at - 1]] & ~_BLANK[text[at + 1]]]
    pad = np.r_[np.zeros(3, np.uint8), text, np.zeros(4, np.uint8)].astype(np.int64)  # pad[i + 3] is text[i]
    high = np.flatnonzero((text[at + 1] >= 0xC2) | (text[at - 1] >= 0x80))
    p = at[high] + 3
    before2, after2 = pad[p - 2] << 8 | pad[p - 1], pad[p + 1] << 8 | pad[p + 2]
    wide = np.isin(before2, _TWO) | np.isin(after2, _TWO) | np.isin(pad[p - 3] << 16 | before2, _THREE) | np.isin(after2 << 8 | pad[p + 3], _THREE)
    at = np.delete(at, high[wide])
    inner = np.zeros(n + 1, bool)
    inner[at] = True
    inner[cut] = True  # a document's own start; a space there leads no unit but is the document's first character
    edge = np.zeros(n + 1, bool)
    edge[cut] = True
    last = np.zeros(n + 1, bool)  # a space at a document's very end stays in its unit
    last[cut[cut > 0] - 1] = True
    inner &= edge | ~last | (np.arange(n + 1) >= n)
    start = np.flatnonzero(inner[:n])
    return start, np.r_[start[1:], n]


def _runs(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether a run of letters, a digit or a run of other characters begins there, and whether it belongs to a character of which that isn't plain to see."""
    kind, odd = _KIND[text], _ODD[text]
    at = np.flatnonzero((text[:-1] == 0xC3) | (text[:-1] == 0xC4))
    odd[at] = np.isin(text[at].astype(np.int64) << 8 | text[at + 1], _NO_LETTERS)
    new = kind == 1
    new[1:] |= kind[1:] != kind[:-1]
    new[start] = True
    new &= (text & 0xC0) != 0x80  # a second byte belongs to the letter before it
    return new, odd


def _before(flag: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flag)]


def run_bounds(text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, and starts and ends of runs of words. A word with an odd character stays one unit in its own case."""
    start, end = word_bounds(text, cut)
    if not len(start):
        return text, start, end
    new, odd = _runs(text, start)
    inner, low = new & ~SPACE[text], _LOWER[text]
    strange = np.unique(np.searchsorted(start, np.flatnonzero(odd), side="right") - 1)
    if len(strange):
        mark = np.zeros(len(text) + 1, np.int8)
        mark[start[strange]] += 1
        mark[end[strange]] -= 1
        whole = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
        inner[whole], low[whole] = False, text[whole]
    leads = np.zeros(len(text), bool)
    leads[start] = True
    inner |= leads
    first = np.flatnonzero(inner)
    return low, first, np.minimum(np.r_[first[1:], len(text)], end[np.cumsum(leads[first]) - 1])


class UnitTokenizer:
    """Encodes texts with a tokenizer file.

    How units are cut follows from the file's pre-tokenizer. Byte-level with its own pattern (a space may
    lead a token): before single spaces between two other characters. A pattern that drops white
    space: at ASCII white space, and between letters, digits and other characters; upper case is its lower case there. Any other: a whole text is one unit. Strings of special tokens
    inside a text are ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        steps = kind.get("pretokenizers", [kind])
        self.words = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex",
            True)
        self.spaced = len(steps) == 1 and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = self.words and bool(suffix) and [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.spaced = self.spaced and spec.get("normalizer") is None
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.spaced else bool(suffix) and t.endswith(suffix))]] = True
        self.most = cache
        self.slots = 1 << max(12, (2 * cache).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.count, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.size, self.head, self.again = (np.zeros(1 << 14, k) for k in (np.int64, np.int64, np.int64, np.uint64, bool))

    def _renew(self) -> None:
        """A full cache keeps the units that were met again, if they fill half of it at most."""
        taken = np.flatnonzero(self.keys)
        keys = np.zeros(self.count, np.uint64)
        keys[self.entry[taken]] = self.keys[taken]
        keep = np.flatnonzero(self.again[: self.count])
        start, n, size, head, flat = self.start[keep], self.length[keep], self.size[keep], self.head[keep], self.flat
        total = int(n.sum())
        self._clear()
        if len(keep) <= self.most // 2 and total <= CACHE_IDS // 2:
            at = np.cumsum(n) - n
            self._store(keys[keep], flat[np.arange(total) + np.repeat(start - at, n)], n, size, head)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 for unknown ones; linear probing in arrays."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.entry[slot[mine]] = entries[mine]
            h, entries, slot = h[~mine], entries[~mine], (slot[~mine] + 1) & (self.slots - 1)

    def _edges(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many tokens of each unit will be an edge (lead with a space, or end a word); 0 where that isn't plain to see."""
        if self.spaced:
            spaces = _before(text == 0x20)
            return np.where((text[start] == 0x20) & (end - start > 1) & (spaces[end] - spaces[start] == 1), 1, 0)
        runs, strange = map(_before, _runs(text, start))
        return np.where(strange[end] == strange[start], runs[end] - runs[start], 0)

    def _encode_units(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit). Units whose edges are known in advance go to the library many in one text."""
        raw, known = text.tobytes(), self._edges(text, start, end) if self.words or self.spaced else np.zeros(len(start), np.int64)
        own: list = [None] * len(start)
        plain = np.flatnonzero(known == 0).tolist()
        joined = np.flatnonzero(known > 0)
        glue = b" " if self.words else b""
        for i in range(0, len(joined), _TOGETHER):
            part = joined[i : i + _TOGETHER]
            units = glue.join([raw[a:b] for a, b in zip(start[part].tolist(), end[part].tolist())]).decode()
            ids = np.asarray(self.tokenizer.encode_batch_fast([units], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != known[part].sum():
                plain += part.tolist()
                continue
            last = np.cumsum(known[part])
            bounds = np.r_[0, at[last - 1] + 1] if self.words else np.r_[at, len(ids)]
            for k, a, b in zip(part.tolist(), bounds.tolist(), bounds[1:].tolist()):
                own[k] = ids[a:b]
        encoded = self.tokenizer.encode_batch_fast([raw[start[k] : end[k]].decode() for k in plain], add_special_tokens=False)
        for k, e in zip(plain, encoded):
            own[k] = np.asarray(e.ids, np.uint32)
        n = np.fromiter(map(len, own), np.int64, len(own))
        return np.concatenate(own) if own else np.zeros(0, np.uint32), n

    def _learn(self, text: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> None:
        ids, n = self._encode_units(text, start, end)
        self._store(h, ids, n, end - start, head)

    def _store(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray, size: np.ndarray, head: np.ndarray) -> None:
        new, total = len(h), len(ids)
        while len(self.start) < self.count + new:
            for name in ("start", "length", "size", "head", "again"):
                setattr(self, name, np.r_[getattr(self, name), np.zeros_like(getattr(self, name))])
        while len(self.flat) < self.used + total:
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        own = slice(self.count, self.count + new)
        self.start[own], self.length[own], self.size[own], self.head[own], self.again[own] = self.used + np.cumsum(n) - n, n, size, head, False
        self.flat[self.used : self.used + total] = ids
        self._insert(h, np.arange(self.count, self.count + new))
        self.count, self.used = self.count + new, self.used + total

    def _slice(self, text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in these bytes, and where each begins (one more at the end)."""
        if self.words:
            text, start, end = run_bounds(text, off[:-1])
        elif self.spaced:
            start, end = space_bounds(text, np.unique(off))
        else:
            start, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
        h = spans(BYTE[text], start, end, _POWERS) | np.uint64(1)
        pad = np.r_[text, np.zeros(8, np.uint8)]
        eight = np.lib.stride_tricks.sliding_window_view(pad, 8)[start]
        head = np.ascontiguousarray(np.where(np.arange(8) < (end - start)[:, None], eight, 0)).view(np.uint64).ravel() if len(start) else np.zeros(0, np.uint64)
        def look() -> tuple[np.ndarray, np.ndarray]:
            at = self._find(h)
            known = at >= 0
            known[known] = (self.size[at[known]] == (end - start)[known]) & (self.head[at[known]] == head[known])
            return at, known

        def unknown() -> np.ndarray:
            _, first = np.unique(h[~known], return_index=True)
            return np.flatnonzero(~known)[first]

        at, known = look()
        self.again[at[known]] = True
        if not known.all():
            first = unknown()
            if self.count + len(first) > self.most or self.used > CACHE_IDS:
                self._renew()
                at, known = look()
                first = unknown()
            self._ensure(len(first))
            self._learn(text, h[first], start[first], end[first], head[first])
            at, known = look()
        n = np.where(known, self.length[at], 0)
        if not known.all():  # units that share a hash with others: rare, encoded on their own
            odd = np.flatnonzero(~known)
            own, n[odd] = self._encode_units(text, start[odd], end[odd])
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = np.zeros(total, np.uint32)
        pick = np.repeat(known, n)
        ids[pick] = self.flat[(np.arange(total) + np.repeat(self.start[at] - (stop - n), n))[pick]]
        if not known.all():
            ids[~pick] = own
        return ids, np.r_[0, stop][np.searchsorted(start, off)]

    def _ensure(self, new: int) -> None:
        """A slice with more units than the table was made for gets a larger one."""
        while 2 * (self.count + new) > self.slots:
            keys, entry = self.keys[self.keys != 0], self.entry[self.keys != 0]
            self.slots *= 2
            self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
            self._insert(keys, entry)

    def encode_array(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a binary array, taken in slices of bounded size."""
        raw, off = data(texts), offsets(texts).astype(np.int64)
        out: list[np.ndarray] = []
        for i, j in slices(texts, _SLICE):
            ids, at = self._slice(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            out += [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_array(pa.array([t.encode() for t in texts], pa.binary()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> UnitTokenizer:
    """One tokenizer of each file per worker process."""
    return UnitTokenizer(path)
