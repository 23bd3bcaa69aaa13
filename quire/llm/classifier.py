"""Quality classifier by compression.

Two Zstandard dictionaries, one of good and one of bad labelled text, serve the same compressor: a text like the good ones
comes out smaller with the good dictionary. The whole text is compressed in chunks (so that a long text cannot serve as its own dictionary) and the
sizes of all chunks are summed. The difference of both sizes, normalised by the size of the text, is all that a score rests on: the rising curve that
fits the labels best, at their own class shares, makes it a probability. For the curve, labelled texts are measured with dictionaries of the other
folds, so none is measured with a dictionary that it helped to build; the final dictionaries are built from all of them.

The fit uses a bounded sample: of the ``fit_rows`` labelled rows of each class with the smallest hashes of their id those whose whole texts fit into
``fit_bytes`` together; a row that doesn't fit is left out, never cut. Scoring covers every row and its whole text.

Defined cases: a null or empty text has the difference 0 and gets the calibrated score of that. Repeated rows get the same score. A long text is
compressed chunk by chunk. Labels of one id with several rows or texts count once each. Without labels of both classes every score is 0.5. Only
``doc_id`` and ``text`` are read; ``labels`` rows with null quality or without a document are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.llm.shared import as_bytes

FIT_ROWS = 1500
FIT_BYTES = 32 << 20  # of each class
FOLDS = 4
DICTIONARY_BYTES = 1 << 16
SAMPLE, SEGMENT, MATCH = 1024, 32, 6  # what the trainer takes for one sample, picks as one piece, and counts
CHUNK = 512
LEVEL = 3
LEAST_CLASS = 2


@dataclass
class Model:
    """Both dictionaries and the calibration; what a task needs, a few hundred kB whatever the data."""

    good: bytes
    bad: bytes
    at: tuple[float, ...] = ()  # differences, ascending, and what they are worth; straight lines between them
    worth: tuple[float, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.good and self.bad)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in (zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)):
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def differences(self, texts: Iterable[bytes]) -> np.ndarray:
        tools = self.compressors()
        return np.array([difference(t, tools) for t in texts])

    def probability(self, differences: np.ndarray) -> np.ndarray:
        """Of label 1, the larger the difference the likelier."""
        return np.interp(differences, self.at, self.worth)

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        if self.empty:
            return np.array([0.5 for _ in texts])
        return self.probability(self.differences(texts))


def difference(text: bytes, compressors: list) -> float:
    """By how many bytes the good dictionary compresses better than the bad one, for each byte of the whole text."""
    if not text:
        return 0.0
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    good, bad = (sum(len(c.compress(p)) for p in parts) for c in compressors)
    return (bad - good) / len(text)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)], level=LEVEL, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The rising curve that is nearest to labels ``y`` at ``x``: neighbours that fall are pooled until none does. Half a label of each kind is added to a pool."""
    pools: list[list[float]] = []  # weighted labels, weight, first and last x
    for a, b, c in zip(*(v[np.lexsort((y, x))].tolist() for v in (x, y, weight))):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            labels, mass, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + labels, pools[-1][1] + mass, pools[-1][2], last]
    worth = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])
    return tuple((p[2] + p[3]) / 2 for p in pools), tuple(worth.tolist())


def learn(rows: dict[int, list[bytes]], share: dict[int, int]) -> Model:
    """The model of labelled texts by class (0, 1), for classes as frequent as ``share`` says."""
    folds = min(FOLDS, len(rows[0]), len(rows[1]))
    if min(len(rows[0]), len(rows[1])) < LEAST_CLASS:
        return Model(b"", b"")
    build = lambda keep: Model(*(dictionary([t for i, t in enumerate(rows[q]) if keep(i % folds)]) for q in (1, 0)))
    x, y = [], []
    for fold in range(folds):
        own = build(lambda f, fold=fold: f != fold)
        for q in (0, 1):
            x.append(own.differences(rows[q][fold::folds]))
            y += [float(q)] * len(x[-1])
    weight = np.array([share[int(q)] / len(rows[int(q)]) for q in y])
    model = build(lambda f: True)
    model.at, model.worth = calibrate(np.concatenate(x), np.array(y), weight / weight.mean())
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learn from labelled rows that are not held out: whole texts of at most ``fit_rows`` ids of each class, of ``fit_bytes`` bytes at most."""
    filled = docs.where("text is not null and text <> ''")
    # an id's rows count with all their bytes, so an id of very many rows is left out, too
    known = filled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1) and doc_id is not null").where(~held_out())
    usable = usable.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", "size")
    # a bounded sample of ids: the smallest hashes, fit_rows of each class, as far as they fit; only their texts are then fetched
    chosen = []
    for q in (0, 1):
        left = fit_bytes
        for r in usable.where(F.col("quality") == q).orderBy("h", "doc_id").limit(fit_rows).collect():
            if r["size"] <= left:
                chosen.append((r["h"], r["doc_id"], r["quality"]))
                left -= r["size"]
    ids = docs.sparkSession.createDataFrame(chosen, "h long, doc_id long, quality int").distinct()
    texts = filled.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    found = texts.select("quality", "h", "text").collect()
    rows = {q: [t.encode() for _, t in sorted({(r["h"], r["text"]) for r in found if r["quality"] == q})] for q in (0, 1)}
    share = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}  # two rows
    return learn(rows, share)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep`` and ``quality_score`` of each row's whole text."""
    kept = docs.select(*keep, as_bytes().alias("__q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(t.as_py() for t in batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, "quality_score"])

    return kept.mapInArrow(run, kept.drop("__q_text").schema.add("quality_score", "double"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""

    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(t.as_py() for t in texts) >= threshold)

    return docs.where(arrow_udf(good, "boolean")(as_bytes()))  # only the text goes to Python, and one bit comes back
