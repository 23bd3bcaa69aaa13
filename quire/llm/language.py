"""Language of a text by cross-parsing against suffix automata of labelled text.

For each language the sampled texts, one after another, become a suffix automaton: every path from its root spells a substring of them. A
text is parsed from its start into phrases, each the longest match with what the language's texts hold (or one symbol that they don't hold);
phrases times the bits that point to a place of those texts, for each symbol of the text, estimate the cross entropy. The language of the lowest one wins.

The fit takes a bounded sample: of each language's texts those with the smallest hashes, whole, ``FIT_ROWS`` at most, as long as they fit into
``FIT_BYTES``, or into their share of ``ALL_BYTES`` where there are many languages; a text that
doesn't fit is left out. Each automaton is built by a task of its own. Prediction covers every row and its whole text:
tasks advance the parses of many texts and all languages together, and finish the few longest ones one by one.

Symbols are the bytes of UTF-8 in lower case; whatever is ASCII and no letter (digits, marks, white space) is a blank.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be learned. Ties go to the
alphabetically first language. The score is 1 - lowest / second lowest entropy, 0 at a tie,
1 where only one language was learned. Rows with null lang or text teach nothing; repeated rows
get the same prediction and teach once. A language none of whose texts fits into its bytes is not learned. An empty table gives an empty result. Only the
id, text and language columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import as_bytes, drop_table, write_table

FIT_ROWS = 400
FIT_BYTES = 1 << 16
ALL_BYTES = 1 << 21
UNKNOWN = "und"
HELD_BYTES = 16 << 20  # text that a task parses together
FEW = 40  # of the longest texts that are finished one by one
LOWER = 0xFFFFFFFF
_SAME = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def symbols(text: bytes) -> bytes:
    """What is compared: bytes of lower case; whatever is ASCII and no letter is a blank."""
    return text.decode(errors="replace").lower().encode().translate(_SAME)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Edges of the states of the smallest automaton of all substrings; state 0 is its root."""
    edges: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        state, at = len(edges), last
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        while at >= 0 and c not in edges[at]:
            edges[at][c] = state
            at = link[at]
        if at >= 0:
            other = edges[at][c]
            if longest[other] == longest[at] + 1:
                link[state] = other
            else:
                split = len(edges)
                edges.append(dict(edges[other]))
                longest.append(longest[at] + 1)
                link.append(link[other])
                link[other] = link[state] = split
                while at >= 0 and edges[at].get(c) == other:
                    edges[at][c] = split
                    at = link[at]
        last = state
    return edges


def table(edges: list[dict[int, int]]) -> tuple[int, np.ndarray]:
    """(root, slots) of an automaton. A state is named by where its slots begin: its edge by symbol c is at slots[state + c] if the upper half of that
    number is the state; the lower half is the state that it leads to."""
    names, used, size = [0] * len(edges), set(), 3 * len(edges) + 1024
    owner, target = [-1] * size, [0] * size
    first = 256
    for s in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
        own = edges[s]
        low = min(own, default=0)
        at, others = first, [c - low for c in own if c != low]
        while owner[at] >= 0 or at - low in used or any(owner[at + d] >= 0 for d in others):
            at += 1
        first = max(first, at - 64)  # the few holes further back are left
        names[s] = at - low
        used.add(at - low)
        for c, t in own.items():
            owner[at - low + c], target[at - low + c] = s, t
        if len(owner) < at + 2048:
            owner += [-1] * len(owner)
            target += [0] * len(target)
    n = max((i for i, s in enumerate(owner) if s >= 0), default=0) + 512
    own, to = np.array(owner[:n], np.int64), np.array(target[:n], np.int64)
    named = np.array(names, np.int64)
    return names[0], np.where(own >= 0, named[own] << 32 | named[to], -1)


@dataclass
class Model:
    """The automata of all languages: root and slots of each, see :func:`table`."""

    languages: tuple[str, ...] = ()
    bits: tuple[float, ...] = ()  # of a place in each language's texts
    tables: tuple[tuple[int, np.ndarray], ...] = ()

    @classmethod
    def of(cls, parts: list[tuple[str, int, int, np.ndarray]]) -> Model:
        """``parts``: language, bytes of its texts, root, slots."""
        parts = sorted(parts, key=lambda p: p[0])
        return cls(tuple(p[0] for p in parts), tuple(float(np.log2(max(2, p[1]))) for p in parts), tuple((p[2], p[3]) for p in parts))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: the phrases that each text takes."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = lengths[order]
        together = int(ends[FEW]) if len(ends) > FEW else 0  # up to here many texts are read symbol by symbol, the longest are finished alone
        alive = np.searchsorted(-ends, -np.arange(together), side="left")
        begin = np.cumsum(alive) - alive
        columns = np.zeros(int(alive.sum()), np.uint8)  # the first symbols of all texts, the second ones, ...
        for lane, i in enumerate(order.tolist()):
            head = np.frombuffer(texts[i], np.uint8)[:together]
            columns[begin[: len(head)] + lane] = head
        for language, (root, slots) in enumerate(self.tables):
            state, count = np.full(len(texts), root), np.zeros(len(texts), np.int64)
            begins = slots[root : root + 256]
            begins = np.where(begins >> 32 == root, begins & LOWER, root)  # after one symbol, or still at the root
            for n, at in zip(alive.tolist(), begin.tolist()):
                symbol, s = columns[at : at + n], state[:n]
                edge = slots.take(s + symbol)
                over = edge >> 32 != s
                count[:n] += over
                lost = np.flatnonzero(over)  # the phrase is over; the next one begins with this symbol, or is only it
                after = begins[symbol[lost]]
                alone = lost[after == root]
                count[alone] += s[alone] != root
                np.bitwise_and(edge, LOWER, out=s)
                s[lost] = after
            out[order, language] = count
            for lane in range(min(FEW, len(texts))):
                i = int(order[lane])
                state[lane], more = _alone(texts[i][together:], int(state[lane]), root, slots, begins.tolist())
                out[i, language] += more
            # a phrase is counted when it is over: one that is open at the end is whole, at the root there is none
            out[order, language] += state != root
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """(languages, scores) of texts given as UTF-8."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cleaned = [symbols(t) if any_letter(t) else b"" for t in texts]
        lengths = np.array([len(t) for t in cleaned])
        entropy = self.phrases(cleaned) * np.array(self.bits) / np.maximum(lengths, 1)[:, None]
        best = entropy.argmin(axis=1)
        two = np.sort(entropy, axis=1)[:, :2]
        score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300) if len(self.languages) > 1 else np.ones(len(texts))
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, lengths)]
        return names, [float(x) if n else 0.0 for x, n in zip(score, lengths)]


def _alone(text: bytes, s: int, root: int, slots: np.ndarray, begins: list[int]) -> tuple[int, int]:
    """(state, phrases that are over) after one text, from state ``s``."""
    edges, n = memoryview(slots), 0
    for symbol in text:
        edge = edges[s + symbol]
        if edge >> 32 == s:
            s = edge & LOWER
        else:
            n += 1 + (s != root and begins[symbol] == root)
            s = begins[symbol]
    return s, n


def any_letter(text: bytes) -> bool:
    return re.search(rb"[A-Za-z]", text) is not None or any(c.isalpha() for c in text.decode(errors="replace"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, all_bytes: int = ALL_BYTES) -> Model:
    """Learn from the text and lang of rows that are not held out."""
    spark = docs.sparkSession
    known = docs.where("text is not null and text <> '' and lang is not null").where(~held_out())
    keyed = known.select("lang", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    thin = write_table(keyed.groupBy("lang", "h").agg(F.max("size").alias("size")), "language-sizes")
    # languages whose share of all bytes is too small to learn from are not learned: the most frequent ones are
    names = [r["lang"] for r in thin.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(all_bytes // 1024).collect()]
    room = min(fit_bytes, all_bytes // max(1, len(names)))
    chosen = []
    for lang in names:  # one small sorted limit each, over ids and sizes only
        left = room
        for r in thin.where((F.col("lang") == lang) & (F.col("size") <= room)).orderBy("h").limit(fit_rows).collect():
            if r["size"] <= left:
                chosen.append((lang, r["h"]))
                left -= r["size"]
    drop_table(thin)
    picked = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))  # at most fit_rows of each language
    texts = known.select("lang", F.xxhash64("text").alias("h"), as_bytes().alias("text")).join(picked, ["lang", "h"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        one = sorted(set(zip(rows.column("h").to_pylist(), rows.column("text").to_pylist())))
        body = b"".join(symbols(t) + b" " for _, t in one)
        root, slots = table(suffix_automaton(body))
        return pa.table({"lang": [key[0].as_py()], "size": [len(body)], "root": [root], "slots": [slots.tobytes()]})

    made = texts.groupBy("lang").applyInArrow(build, "lang string, size long, root long, slots binary").collect()  # one row a language
    return Model.of([(r["lang"], r["size"], r["root"], np.frombuffer(r["slots"], np.int64)) for r in made])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``lang_pred`` and ``score`` of each row's whole text."""
    kept = docs.select(*keep, as_bytes().alias("__l_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting, size = shared.value, [], 0

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            lang, score = found.predict(rows.column(len(keep)).to_pylist())
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns[: len(keep)]),
                    pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield done()
                waiting, size = [], 0
        if waiting and sum(b.num_rows for b in waiting):
            yield done()

    return kept.mapInArrow(run, kept.drop("__l_text").schema.add("lang_pred", "string").add("score", "double"))
