"""Token ids in a content-addressed store.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream into chunks wherever the ids
themselves say so, so equal stretches give equal chunks in any document. A chunk is named by its
BLAKE2b digest and stored once, by the task that its name is dealt to. A document is a recipe (the
names of its chunks in order); its root is the Merkle root of those names, a recipe file's root that of
its documents' roots, a chunk file's that of its chunks' names, and the manifest's that of its rows. All of them are checked when
the store is read: a manifest that lacks a row, or has two of them mixed up, is refused before anything else is read.

Layout below a folder: ``chunks/*.chunks`` (name, ids, packed payload), ``recipes/*.recipes`` (header, then a
record for each document in ascending doc_id order, with its first id's place), ``manifest.parquet`` (one row for each file;
the commit). Copies of a hot chunk are dropped in each task before they are shuffled.

Defined cases: a null text is an empty one, with the end id alone. Null doc_ids sort first and keep
their place. Repeated rows are stored as recipes of the same chunks; rows of one doc_id are in the order of their roots. A long text is
tokenized in parts and cut into many chunks, none above ``MAX_IDS`` ids. An empty table gives a manifest without files. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.files import reading, task_file, writing
from quire.llm.shared import as_bytes, drop_table, write_table
from quire.llm.tokens import tokenizer

WINDOW = 8
MIN_IDS, MEAN_IDS, MAX_IDS = 512, 2048, 8192
NAME = 16
SEEN = 100_000  # chunk names a task remembers, to send its copies of a chunk once
_CHUNK = "<16sIII"  # name, ids, payload bytes, checksum
_RECIPE = "<?qqQI16sI"  # null id, doc_id, start, ids, crc32, root, recipe bytes
_MAGIC = b"IDRECIP1"


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NAME).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed under different prefixes."""
    level = [name_of(b"\0" + x) for x in leaves] or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, least: int = MIN_IDS, mean: int = MEAN_IDS, most: int = MAX_IDS) -> list[int]:
    """Ends of the chunks of an id stream; ``mean`` is a power of two."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    h = np.zeros(n, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    for j in range(WINDOW):  # the hash of ids[i-WINDOW+1 .. i]
        h[j:] += x[: n - j] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    stops = np.flatnonzero((h >> np.uint64(32)) & np.uint64(mean - 1) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(stops, at + least)
        end = min(int(stops[i]) if i < len(stops) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _recipes_and_chunks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows of both kinds, dealt by ``name``: recipes (a chunk-less name) and chunks (no recipe)."""
    names = ["name", "payload", "n", "doc_id", "recipe", "root", "crc"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = tokenizer(tokenizer_path), zstandard.ZstdCompressor(level=1)
        width = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        seen: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows: list[tuple] = []
                for doc_id, own in zip(part.column(0).to_pylist(), encoder.encode_array(part.column(1))):
                    raw = own.tobytes() + end
                    ids, at, recipe = np.frombuffer(raw, "<u4"), 0, []
                    for to in cuts(ids):
                        data = ids[at:to].astype(width).tobytes()
                        recipe.append(name_of(data))
                        if recipe[-1] not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(recipe[-1])
                            rows.append((recipe[-1], pack.compress(data), to - at, None, None, None, None))
                        at = to
                    rows.append((None, None, len(ids), doc_id, b"".join(recipe), merkle(recipe), zlib.crc32(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, "name binary, payload binary, n long, doc_id long, recipe binary, root binary, crc long")


def _store_chunks(rows: DataFrame, folder: str) -> DataFrame:
    """Write each chunk once, pass the recipes on: (doc_id, n, recipe, root, crc) and a row (path, n) for each file."""
    dealt = rows.repartition("name", "doc_id").sortWithinPartitions("name")  # chunks by name, recipes by document
    names = ["doc_id", "n", "recipe", "root", "crc", "path"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        path, last, stored = task_file(f"{folder}/chunks", ".chunks"), None, []
        with writing(path) as f:
            while batch is not None:
                out = []
                for name, payload, size, *recipe in zip(*(c.to_pylist() for c in batch.columns)):
                    if name is None:
                        out.append((recipe[0], size, *recipe[1:], None))
                    elif name != last:
                        f.write(struct.pack(_CHUNK, name, size, len(payload), zlib.crc32(payload)) + payload)
                        last = name
                        stored.append(name)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, len(stored), None, merkle(stored), None, path), kinds)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n long, recipe binary, root binary, crc long, path string")


def _store_recipes(recipes: DataFrame, folder: str) -> DataFrame:
    """Recipe files, each a range of ascending doc_ids: (path, part, documents, ids, root) of each."""
    parts = max(1, int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        path, start, n, roots = task_file(f"{folder}/recipes", ".recipes"), 0, 0, []
        with writing(path) as f:
            f.write(_MAGIC)
            while batch is not None:
                for doc_id, size, recipe, root, crc in zip(*(c.to_pylist() for c in batch.columns)):
                    f.write(struct.pack(_RECIPE, doc_id is None, doc_id or 0, start, size, crc, root, len(recipe)) + recipe)
                    start, n = start + size, n + 1
                    roots.append(root)
                batch = next(batches, None)
        part = TaskContext.get().partitionId()
        row = zip(("path", "part", "documents", "ids", "root"), ([path], [part], [n], [start], [merkle(roots)]))
        yield pa.RecordBatch.from_pydict(dict(row), schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())]))

    return ranged.select("doc_id", "n", "recipe", "root", "crc").mapInArrow(run, "path string, part long, documents long, ids long, root binary")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Store the ids of ``docs`` below ``folder``; the manifest (kind, path, part, start, documents, ids, root)."""
    spark = docs.sparkSession
    made = write_table(_store_chunks(_recipes_and_chunks(docs, tokenizer_path, end_id), folder), "recipes")
    recipe_files = write_table(_store_recipes(made.where("path is null").drop("path"), folder), "recipe-files")
    # one row for each file, whatever the documents
    files, at = [], 0
    for path, part, documents, ids, root in sorted(map(tuple, recipe_files.collect()), key=lambda r: r[1]):
        files.append(("recipes", path, part, at, documents, ids, bytes(root)))
        at += ids
    files += [("chunks", path, None, 0, n, None, bytes(root)) for path, n, root in made.where("path is not null").select("path", "n", "root").collect()]
    files.append(("manifest", None, None, 0, len(files), at, manifest_root(files)))
    spark.createDataFrame(files, "kind string, path string, part long, start long, documents long, ids long, root binary").coalesce(1).write.parquet(f"{folder}/manifest.parquet")
    for done in (made, recipe_files):
        drop_table(done)
    return spark.read.parquet(f"{folder}/manifest.parquet")


def manifest_root(files: list[tuple]) -> bytes:
    """Root over the manifest's rows (kind, path, part, start, documents, ids, root), in the order of what they say."""
    return merkle(sorted("\0".join(x.hex() if isinstance(x, bytes) else str(x) for x in row).encode() for row in files))


def checked(manifest: DataFrame) -> DataFrame:
    """The files of a manifest whose rows are those that were written, each once."""
    rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in manifest.select("kind", "path", "part", "start", "documents", "ids", "root").collect()]
    files = [r for r in rows if r[0] != "manifest"]
    heads = [r for r in rows if r[0] == "manifest"]
    if len(heads) != 1 or heads[0][4] != len(files) or heads[0][6] != manifest_root(files):
        raise ValueError("the manifest does not match its root")
    return manifest.where("kind <> 'manifest'")


def _paths(manifest: DataFrame, kind: str, *columns: str) -> DataFrame:
    some = checked(manifest).where(F.col("kind") == kind).select("path", *columns)
    return some.repartition(max(1, min(some.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism)), "path")


def read_recipes(manifest: DataFrame) -> DataFrame:
    """(row, doc_id, start, n, crc, root, recipe): ``row`` is unique, ``start`` counts all ids before it."""
    names = ["row", "doc_id", "start", "n", "crc", "root", "recipe"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, first, documents, root in zip(*(c.to_pylist() for c in batch.columns)):
                rows, roots, n = [], [], 0
                with reading(path) as f:
                    if f.read(len(_MAGIC)) != _MAGIC:
                        raise ValueError(f"not a recipe file: {path}")
                    while head := f.read(struct.calcsize(_RECIPE)):
                        none, doc_id, start, size, crc, own, length = struct.unpack(_RECIPE, head)
                        recipe = f.read(length)
                        if merkle([recipe[i : i + NAME] for i in range(0, length, NAME)]) != own:
                            raise ValueError(f"damaged recipe in {path}")
                        rows.append((part << 40 | n, None if none else doc_id, first + start, size, crc, own, recipe))
                        roots.append(own)
                        n += 1
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if n != documents or merkle(roots) != root:
                    raise ValueError(f"{path} does not match the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _paths(manifest, "recipes", "part", "start", "documents", "root").mapInArrow(run, "row long, doc_id long, start long, n long, crc long, root binary, recipe binary")


def read_chunks(manifest: DataFrame) -> DataFrame:
    """(name, payload) of every stored chunk, still packed; checksums are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, documents, root in zip(*(c.to_pylist() for c in batch.columns)):
                with reading(path) as f:
                    rows, size, stored = [], 0, []
                    while head := f.read(struct.calcsize(_CHUNK)):
                        name, _, length, crc = struct.unpack(_CHUNK, head)
                        payload = f.read(length)
                        if zlib.crc32(payload) != crc:
                            raise ValueError(f"damaged chunk in {path}")
                        rows.append((name, payload))
                        stored.append(name)
                        size += length
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["name", "payload"])
                            rows, size = [], 0
                    if len(stored) != documents or merkle(stored) != root:
                        raise ValueError(f"{path} does not match the manifest")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["name", "payload"])

    return _paths(manifest, "chunks", "documents", "root").mapInArrow(run, "name binary, payload binary")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, rebuilt from its chunks and verified against its root."""
    recipes = read_recipes(manifest)
    n = F.length("recipe") / NAME
    places = recipes.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring("recipe", i * NAME + 1, F.lit(NAME)))).alias("seq", "name"))
    # what tasks read from files has no statistics: the hints keep it from being taken for small and broadcast
    found = places.join(read_chunks(manifest).hint("merge"), "name", "left")
    whole = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("chunks"))
    # the manifest's ids tell the width: two bytes where the payload's size is twice the ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, start, size, crc, root, chunks in zip(*(batch.column(i) for i in range(6))):
                chunks = chunks.as_py()
                if any(c["payload"] is None for c in chunks):
                    raise ValueError(f"a chunk of document {doc_id} is not in the store")
                data = [unpack.decompress(c["payload"]) for c in chunks]
                if merkle([name_of(d) for d in data]) != root.as_py():
                    raise ValueError(f"document {doc_id} does not match its root")
                raw, count = b"".join(data), size.as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4").tobytes()
                if len(ids) != 4 * count or zlib.crc32(ids) != crc.as_py():
                    raise ValueError(f"document {doc_id} does not match its recipe")
                rows.append((doc_id.as_py(), start.as_py(), count, zlib.crc32(ids), ids)[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return recipes.drop("recipe").join(whole.hint("merge"), "row").select("doc_id", "start", "n", "crc", "root", "chunks").mapInArrow(run, schema)
