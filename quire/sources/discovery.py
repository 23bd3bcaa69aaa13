"""Finding, sifting and naming documents. A listing is a DataFrame with ``path`` (and size, identity, ...)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.files import read_file, write_file
from quire.functions.tables import written

# fixed values: what the extractor accepts, and folders that hold no documents
SUPPORTED_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp", "gif", "heic", "heif")
EXCLUDED_FOLDERS = ("node_modules", "dist", "build", "vendor", "target")
INSTRUCTION_NAMES = ("claude", "claude.local", "agents", "agent", "gemini", "copilot-instructions", "codex", "cursorrules", ".cursorrules",
                     "windsurfrules", ".windsurfrules", ".clinerules", "conventions", "skill")
MAX_FILES, MAX_TOTAL_MB = 1000, 5120
MAX_IMAGE_BYTES, MAX_PDF_BYTES = 70 << 20, 50 << 20
CHUNK_BYTES = 65536
READ_BYTES = 4 << 20  # bytes of files in one batch that is read back
ARTIFACTS = {"md": "markdown", "json": "json", "csv": "csv", "steps.json": "steps"}  # extension -> column of a result


def extension(path: str | Column = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def classify_files(files: DataFrame, hidden: bool = False, default_excludes: bool = True) -> DataFrame:
    """D01 on a listing: ``verdict`` is supported, unsupported, excluded or hidden. The first segment is the scan's
    root, which is never excluded."""
    inner = F.expr("slice(split(path, '/'), 2, size(split(path, '/')))")
    folders = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    excluded = F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_FOLDERS))) if default_excludes else F.lit(False)
    is_hidden = F.lit(False) if hidden else F.exists(inner, lambda s: s.startswith("."))
    verdict = F.when(excluded, "excluded").when(is_hidden, "hidden").when(extension().isin(*SUPPORTED_EXTENSIONS), "supported").otherwise("unsupported")
    return files.withColumn("verdict", verdict)


def scan_documents(spark: SparkSession, roots: Sequence[str], hidden: bool = False, default_excludes: bool = True) -> DataFrame:
    """D01 on storage: path, size and modification time of all files below ``roots``, with their verdict. Contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path", F.col("length").alias("size"), "modificationTime")
    tails = F.coalesce(*[F.when(F.col("path").contains(r), F.concat(F.lit("root"), F.regexp_extract("path", re.escape(r.rstrip("/")) + "(/.*)$", 1))) for r in roots])
    return classify_files(listing.withColumnRenamed("path", "full_path").withColumn("path", F.regexp_replace("full_path", "^file:", "")).withColumn("path", tails), hidden, default_excludes)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return f"^{out}$"


def _hit(pattern: str, root: str) -> Column:
    """Whether a pattern matches relative to the scan's root or, unless absolute or ``**``, to the working folder."""
    inner = F.regexp_replace("path", f"^{re.escape(root)}/", "")
    hit = inner.rlike(glob_regex(pattern))
    if not pattern.startswith(("/", "**")):
        hit |= F.col("path").rlike(glob_regex(pattern.removeprefix("./")))
    return hit


def apply_excludes(files: DataFrame, patterns: Sequence[str], root: str = "root") -> DataFrame:
    """Files that no pattern hits; the patterns become one condition of the scan."""
    out = files
    for p in patterns:
        out = out.where(~_hit(p, root))
    return out


def unmatched_excludes(files: DataFrame, patterns: Sequence[str], root: str = "root", ambient: Sequence[str] = ()) -> DataFrame:
    """Patterns that hit nothing, ``ambient`` (configured) ones aside. One pass, one row."""
    own = [p for p in patterns if p not in ambient]
    found = files.agg(*[F.coalesce(F.bool_or(_hit(p, root)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(own)])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("matched")) for i, p in enumerate(own)]))
    return found.select(rows.alias("r")).select("r.*").where(~F.col("matched")).select("pattern")


def skip_report(dropped: DataFrame, n: int = 3) -> DataFrame:
    """(reason, count, names): the ``n`` first names of each reason by a rank, so no group is gathered."""
    first = dropped.withColumn("rank", F.row_number().over(W.partitionBy("reason").orderBy("name"))).where(F.col("rank") <= n)
    names = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return dropped.groupBy("reason").agg(F.count("*").alias("count")).join(names, "reason")


def dedupe_inputs(files: DataFrame, identity_col: str = "identity") -> DataFrame:
    """Every path with ``kept``, the first by name of its identity; a duplicate is a row whose path isn't ``kept``."""
    first = files.groupBy(identity_col).agg(F.min("path").alias("kept"))
    return files.join(first, identity_col).select("path", "kept", (F.col("path") != F.col("kept")).alias("duplicate"))


def sniffed(head: Column) -> Column:
    """Media type by signature, from the hex of the first bytes; null if none is known."""
    box = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    end = F.when(box == 0, F.length(head) / 2).otherwise(F.least(box, F.length(head) / 2))
    compatible = F.filter(F.transform(F.sequence(F.lit(16), F.lit(252), F.lit(4)), lambda o: F.when(o + 4 <= end,
                F.substring(head, o * 2 + 1, F.lit(8)))), lambda b: b.isNotNull() & (F.length(b) == 8))
    brand = F.when((F.substring(head, 9, 8) == "66747970") & (box != 1) & ((box == 0) | (box >= 16)), F.concat(F.array(F.substring(head, 17, 8)), compatible))
    has = lambda *names: F.arrays_overlap(brand, F.array(*[F.lit(n.encode().hex().upper()) for n in names]))
    return (F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
            .when(has("avif", "avis"), F.lit(None)).when(has("heic", "heix", "hevc", "hevx"), "image/heic").when(has("mif1", "msf1", "heim", "heis", "hevm", "hevs"), "image/heif"))


def check_media(files: DataFrame) -> DataFrame:
    """(path, declared, sniffed, verdict) from (path, declared, size, content); only the first 256 bytes are looked at."""
    head = files.withColumn("h", F.hex(F.substring("content", 1, 256)))
    found = head.select("path", "declared", "size", sniffed(F.col("h")).alias("sniffed"))
    limit = F.when(F.col("declared") == "application/pdf", MAX_PDF_BYTES).otherwise(MAX_IMAGE_BYTES)
    verdict = (F.when(F.col("size") == 0, "empty").when(F.col("size") > limit, "too-large").when(F.col("sniffed").isNull(), "unknown")
        .when(F.col("sniffed") != F.col("declared"), "mismatch").otherwise("ok"))
    return found.select("path", "declared", "sniffed", verdict.alias("verdict"))


def binary_pages(pages: DataFrame, text_col: str = "html", most: float = 0.01) -> DataFrame:
    """D06 for fetched pages: those with a NUL or more than ``most`` control characters pose as text."""
    t = F.col(text_col)
    controls = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0B\x0E-\x1F\x7F]", ""))
    return pages.withColumn("binary", t.contains("\0") | (controls > most * F.length(t)))


def check_budget(files: DataFrame, max_files: int = MAX_FILES, max_total_mb: int = MAX_TOTAL_MB) -> DataFrame:
    """One row: files, bytes, and whether each is within its limit."""
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return total.select("files", "bytes", (F.col("files") <= max_files).alias("files_ok"), (F.col("bytes") <= max_total_mb * 1024 * 1024).alias("bytes_ok"))


def media_support(files: DataFrame, providers: Sequence[tuple[str, Sequence[str] | None, str]]) -> DataFrame:
    """(path, provider, supported) for files (path, mime) and providers (name, image types, pdfs). No image types takes any image;
    pdfs is true, false, model-dependent or unknown, and only false refuses. Providers are a short list: each file meets it in its own row."""
    one = lambda name, images, pdfs: F.struct(F.lit(name).alias("provider"),
        (F.array(*map(F.lit, images)) if images is not None else F.lit(None).cast("array<string>")).alias("images"), F.lit(pdfs).alias("pdfs"))
    pair = files.select("path", "mime", F.explode(F.array(*[one(*p) for p in providers])).alias("p"))
    ok = F.when(F.col("mime") == "application/pdf", F.col("p.pdfs") != "false").otherwise(F.col("p.images").isNull() | F.array_contains("p.images", F.col("mime")))
    return pair.select("path", "p.provider", ok.alias("supported"))


def plan_output_paths(docs: DataFrame, out_dir: str, formats: Sequence[str]) -> DataFrame:
    """(path, format, target) for each document (relative ``path``) and format."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: ~s.isin("", ".", ".."))
    last = F.element_at(parts, -1)
    stem = F.when(last.rlike(r"^\.[^.]*$"), last).otherwise(F.regexp_replace(last, r"\.[^.]*$", ""))
    safe = F.when(F.lower(stem).isin(*INSTRUCTION_NAMES), F.concat(stem, F.lit(".ocr"))).otherwise(stem)
    shown = F.transform(F.concat(folders, F.array(safe)), lambda s: F.when(s.startswith("."), F.concat(F.lit("_"), s)).otherwise(s))
    base = docs.select("path", F.array_join(F.concat(F.array(F.lit(out_dir)), shown), "/").alias("base"))
    return base.select("path", "base", F.explode(F.array(*map(F.lit, formats))).alias("format")).select("path", "format", F.concat_ws(".", "base", "format").alias("target"))


def output_collisions(planned: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """(target, kind, owners): targets claimed twice (case-folded), or used as a folder of another target."""
    keys = planned.select(F.lower("target").alias("key"))
    if reserved:
        keys = keys.unionByName(planned.sparkSession.createDataFrame([(r.lower(),) for r in reserved], "key string"))
    counts = keys.groupBy("key").agg(F.count("*").alias("owners"))
    twice = counts.where("owners > 1").select(F.col("key").alias("target"), F.lit("same-path").alias("kind"), "owners")
    part = F.split("key", "/")
    parents = (counts.select("owners",
            F.explode(F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda i: F.array_join(F.slice(part, 1, i), "/"))).alias("parent"))
        .groupBy("parent").agg(F.sum("owners").alias("below")))
    folder = counts.join(parents, F.col("key") == F.col("parent")).select(F.col("key").alias("target"), F.lit("file-and-folder").alias("kind"), (F.col("owners") + F.col("below")).alias("owners"))
    return twice.unionByName(folder)


def occupied_targets(planned: DataFrame, existing: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(source, target) planned, already there, and not owned by the same source; without a manifest (resume is off) all that is there."""
    taken = planned.join(existing.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target")
    if manifest is None:
        return taken
    owned = manifest.select("source", F.explode("owned_files").alias("target"))
    return taken.join(owned, ["source", "target"], "left_anti")


def _artifacts(fmt: str, row: dict) -> list[tuple[str, bytes]]:
    """(extension, body) of what a result has and ``fmt`` asks for: text ends with one line end at least, JSON is indented."""
    lines = lambda t: (t if t.endswith("\n") else t + "\n").encode()
    pretty = lambda t: (json.dumps(json.loads(t), indent=2, ensure_ascii=False) + "\n").encode()
    asked = {"markdown": ["md"], "json": ["json"], "csv": ["csv"], "all": ["md", "json", "csv", "steps.json"]}[fmt]
    return [(x, (pretty if x.endswith("json") else lines)(row[ARTIFACTS[x]])) for x in asked if row.get(ARTIFACTS[x]) not in (None, "")]


def write_artifacts(results: DataFrame, folder: str, fmt: str = "all") -> DataFrame:
    """The artifacts of each result as files of their own; returns (target, path, bytes, error), a row for each file or refusal.

    ``results``: target (below ``folder``, without extension) and any of markdown, json, csv, steps (texts). ``fmt``: markdown, json, csv or all. A result
    without a csv in a csv-only run is ``csv-missing``, one with nothing that is asked for ``nothing-to-write``, broken JSON ``bad-json``. Tasks write the
    files, each whole under its name; writing them again gives the same files."""
    names = ["target", "path", "bytes", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    found = _artifacts(fmt, row)
                except ValueError:
                    out.append((row["target"], None, None, "bad-json"))
                    continue
                if not found:
                    out.append((row["target"], None, None, "csv-missing" if fmt == "csv" else "nothing-to-write"))
                for kind, body in found:
                    path = f"{folder.rstrip('/')}/{row['target']}.{kind}"
                    write_file(path, body)
                    out.append((row["target"], path, len(body), None))
            yield pd.DataFrame(out, columns=names)

    some = results.select("target", *[c for c in ARTIFACTS.values() if c in results.columns])
    some = some.repartition(max(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "target")  # few large row groups would be few tasks
    return written(some.mapInPandas(run, "target string, path string, bytes long, error string"), "artifacts-written")


def read_artifacts(made: DataFrame) -> DataFrame:
    """(path, content) of the files that :func:`write_artifacts` names, each once, read by the tasks that hold their names: a folder of millions of small files is never listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, bodies, size = [], [], 0
            for path in batch.column(0).to_pylist():
                paths.append(path)
                bodies.append(read_file(path))
                size += len(bodies[-1])
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
                    paths, bodies, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])

    # dealt by number: names are few bytes, and would be put together into few tasks
    parts = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return made.where("path is not null").select("path").repartition(parts, "path").distinct().mapInArrow(run, "path string, content binary")


class _Chunks:
    """The chunks of one text, one after another: only one is held at a time."""

    def eval(self, text: str | None, most: int):
        raw, at, n = (text or "").encode(), 0, 0
        while at < len(raw) or n == 0:
            end = min(len(raw), at + most)
            while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
            yield n, at, end, len(raw), end == len(raw), raw[at:end].decode("utf-8", "replace")
            at, n = end, n + 1


def chunk_artifacts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, chunk_no, offset, next_offset, total, eof, chunk): texts cut at ``max_bytes`` bytes or fewer, never inside a code point. A table function joined laterally to the texts."""
    chunks = F.udtf(_Chunks, returnType="chunk_no long, offset long, next_offset long, total long, eof boolean, chunk string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.lateralJoin(chunks(F.col("text").outer(), F.lit(max_bytes))).drop("text")
