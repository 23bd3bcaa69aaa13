"""Dictionary-compressed WARC archives (.warc.zst).

A Zstandard dictionary is trained on a hash-chosen sample of the records to be archived, bounded in number and bytes. Every
archive file begins with it in a skippable frame (0x184D2A5D, the dictionary itself compressed), then
each record is a Zstandard frame of its own: a reader can start at any frame it has an offset of.

Of records with one payload of ``min_bytes`` or more, that with the largest page_id is a ``response``,
the others ``revisit`` it. The groups are met by a join on the payload's SHA-1 that adaptive execution
splits where one payload is hot. Tasks write files of at most ``file_bytes`` of payload; the manifest
table that lists them is the commit.

Defined cases: a null html is an empty payload, a null url an empty target. A null page_id ranks below
every other. Repeated rows with the largest page_id of a payload are all responses. An empty table
gives an empty manifest. Extra columns are ignored. A very long page is one record like any other; a file holds it whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.files import reading, task_file, writing
from quire.llm.shared import _files_cleaned

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 32 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # pages carry no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space of RFC 4122
_READ = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which leaves the payload out."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and block of a record; payload None for a revisit. Digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    payload = body if fields["WARC-Type"] == "response" else None
    if payload is not None and (len(payload) != size or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def train(pages: DataFrame, records: int = SAMPLE_RECORDS, most: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the ``records`` pages of the smallest hashes, each of them whole; one that would take the sample beyond ``most`` bytes is left out."""
    rows = pages.where("html is not null").select(F.xxhash64("html").alias("h"), F.octet_length("html").cast("long").alias("size"), "html")
    # hashes and sizes first, a few numbers of each task; then the texts of those that were chosen
    chosen, left = [], most
    for r in rows.select("h", "size").distinct().orderBy("h", "size").limit(records).collect():
        if r["size"] <= left:
            chosen.append(tuple(r))
            left -= r["size"]
    picked = pages.sparkSession.createDataFrame(chosen, "h long, size long")
    sample = rows.join(F.broadcast(picked), ["h", "size"]).select("h", "html").distinct().orderBy("h", "html").limit(records).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["html"].encode() for r in sample], level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(r["html"].encode() for r in sample)[-DICTIONARY_BYTES:] or b"<!DOCTYPE html>"


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to of revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    last = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("last_id"))
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return rows.join(last, ["sha", "size"], "left").select("page_id", "url", "payload", F.when(revisit, F.col("last_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``pages`` below ``folder``; the manifest (path, records, payload_bytes) of the files."""
    spark = pages.sparkSession
    dictionary = train(pages)
    lead = dictionary_frame(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary)
        trained.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(dict_data=trained, write_content_size=True)
        rows = (row for batch in batches for row in zip(*(batch.column(i) for i in range(4))))
        row = next(rows, None)
        while row is not None:
            path, n, size = task_file(folder, ".warc.zst"), 0, 0
            with writing(path) as f:
                f.write(lead)
                while row is not None and size < file_bytes:
                    page_id, url, payload, refers_to = (x.as_py() for x in row)
                    f.write(compressor.compress(record(page_id, url, payload, refers_to)))
                    n, size = n + 1, size + len(payload)
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "payload_bytes"])

    manifest = f"{folder}/manifest.parquet"
    with _files_cleaned(spark):
        roles(pages, min_bytes).mapInArrow(run, "path string, records long, payload_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def frames(f) -> Iterator[bytes]:
    """The records of an archive file, frame by frame, in bounded memory; the dictionary is the file's own."""
    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(f.read(size)))
    unpack, rest = zstandard.ZstdDecompressor(dict_data=dictionary), b""
    one = unpack.decompressobj()
    out: list[bytes] = []
    while True:
        rest = rest or f.read(_READ)
        if not rest:
            if out:
                raise ValueError("the last frame is cut short")
            return
        out.append(one.decompress(rest))
        rest = b""
        if one.eof:
            rest = one.unused_data
            yield b"".join(out)
            one, out = unpack.decompressobj(), []


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the files that ``manifest`` lists: page_id, record_type, refers_to, payload digest and size, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reading(path) as f:
                    rows: list[tuple] = []
                    size = 0
                    for raw in frames(f):
                        r = parse(raw)
                        h = r["fields"]
                        number = [int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((number[0], h["WARC-Target-URI"], h["WARC-Type"], number[1], h["WARC-Payload-Digest"][5:], r["payload_bytes"], r["payload"]))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism)), "path")
    return paths.mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write and read back."""
    return read(write(pages, folder, min_bytes))
