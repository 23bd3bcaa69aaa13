"""Structured Streaming: resumable ingest and live usage, and the batch forms of the streams with state (:mod:`quire.streaming.stateful`)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.resume import latest_entries

TIMEOUT_SECONDS = 120
TERMINAL = ("document.completed", "document.failed", "document.partial", "document.skipped")
RUN_END = ("run.completed", "run.failed")
MANIFEST = "source string, fingerprint string, fingerprint_version int, status string, output_files array<string>, owned_files array<string>, updated long"
_ENTRY = ["source", "fingerprint", "status", "output_files", "owned_files", "updated"]
COMPACT_EVERY = 64


class ManifestLog:
    """The manifest of streams that share a folder: a whole table, and one delta for each micro-batch since.

    ``folder/delta/run=R/batch=N`` holds the rows of batch N of the query R, ``folder/log/K`` version K of the whole table: where it is, and for each query the
    number of its first batch that isn't part of it. A version is put only where there is none of its number, so of compactions at once one counts. What a
    query's batch N sees are the newest version and all deltas that this doesn't hold, but of its own only those before N: a repeated batch never
    sees itself. A delta is settled when its query has written a later one, which it does once the earlier batch is committed; only settled deltas become
    part of a version, so no query folds what another may repeat. Files go when a later version than the one that replaced them is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _below(self, folder: str, prefix: str = "") -> dict[str, str]:
        """What follows ``prefix`` in the names in ``folder``, and their paths."""
        at = self.path(folder)
        if not self.fs.exists(at):
            return {}
        return {s.getPath().getName().removeprefix(prefix): s.getPath().toString() for s in self.fs.listStatus(at) if s.getPath().getName().startswith(prefix)}

    def _version(self, path: str) -> dict | None:
        """What a version says; null while it is being written."""
        stream = self.fs.open(self.path(path))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def versions(self) -> dict[int, dict]:
        """The two newest versions by number: {"whole": path, "marks": {run: first batch that isn't part of it}}."""
        found = sorted((int(k), p) for k, p in self._below(f"{self.folder}/log").items() if k.isdigit())[-3:]
        read = {k: self._version(p) for k, p in found}
        return dict(sorted((k, v) for k, v in read.items() if v)[-2:])

    def deltas(self) -> dict[tuple[str, int], str]:
        """The deltas that are whole, by query and batch."""
        runs = self._below(f"{self.folder}/delta", "run=")
        return {(r, int(n)): p for r, folder in runs.items() for n, p in self._below(folder, "batch=").items() if self.fs.exists(self.path(p, "_SUCCESS"))}

    def _merged(self, whole: str | None, deltas: list[str]) -> DataFrame:
        paths = [*([whole] if whole else []), *deltas]
        rows = self.spark.read.schema(MANIFEST).parquet(*paths) if paths else self.spark.createDataFrame([], MANIFEST)
        return latest_entries(rows.select(*_ENTRY))

    def before(self, run: str, number: int, compact_every: int = COMPACT_EVERY) -> DataFrame:
        """The entries as batch ``number`` of ``run`` must see them; ``compact_every`` settled deltas become a new version first."""
        versions = self.versions()
        newest = max(versions, default=0)
        state = versions.get(newest, {"whole": None, "marks": {}})
        open_ = {(r, n): p for (r, n), p in self.deltas().items() if n >= state["marks"].get(r, 0)}
        last = {r: max(n for q, n in open_ if q == r) for r, _ in open_} | {run: number}
        settled = {(r, n): p for (r, n), p in open_.items() if n < last[r]}
        if len(settled) >= compact_every and self.put(newest + 1, state, settled):
            self.clear(versions)
            return self.before(run, number, 1 << 62)
        return self._merged(state["whole"], [p for (r, n), p in open_.items() if r != run or n < number])

    def put(self, number: int, state: dict, settled: dict[tuple[str, int], str]) -> bool:
        """Make version ``number`` of ``state`` and settled deltas; whether it is the one that counts."""
        whole = f"{self.folder}/whole-{number}-{uuid.uuid4().hex}"
        self.write(self._merged(state["whole"], list(settled.values())), whole)
        marks = state["marks"] | {r: max(n for q, n in settled if q == r) + 1 for r, _ in settled}
        try:
            out = self.fs.create(self.path(f"{self.folder}/log/{number}"), False)
        except Py4JJavaError:
            if not self.fs.exists(self.path(f"{self.folder}/log/{number}")):
                raise
            self.fs.delete(self.path(whole), True)  # another query was first
            return False
        out.write(bytearray(json.dumps({"whole": whole, "marks": marks}).encode()))
        out.close()
        return True

    def clear(self, versions: dict[int, dict]) -> None:
        """Delete what no reader of the newest of ``versions``, or of a later one, needs: files of older versions, and the deltas that it holds."""
        if not versions:
            return
        newest = max(versions)
        kept = {self.path(v["whole"]).getName() for v in self.versions().values()} | {self.path(versions[newest]["whole"]).getName()}
        for k, p in self._below(self.folder, "whole-").items():
            if f"whole-{k}" not in kept and int(k.split("-")[0]) < newest:
                self.fs.delete(self.path(p), True)
        for (r, n), p in self.deltas().items():
            if n < versions[newest]["marks"].get(r, 0):
                self.fs.delete(self.path(p), True)
        for k, p in self._below(f"{self.folder}/log").items():
            if k.isdigit() and int(k) < newest:
                self.fs.delete(self.path(p), True)

    def write(self, rows: DataFrame, to: str) -> None:
        rows.withColumn("fingerprint_version", F.lit(2)).select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.mode("overwrite").parquet(to)

    def entries(self) -> DataFrame:
        """The newest entry of every source."""
        return self.before("", 0, 1 << 62)


def new_documents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(source, fingerprint, content) of (path, content) rows whose newest entry in ``known`` isn't a success of the same content."""
    new = rows.select(F.col("path").alias("source"), F.sha2("content", 256).alias("fingerprint"), "content").dropDuplicates(["source", "fingerprint"])
    return new.join(known.where("status = 'succeeded'").select("source", "fingerprint"), ["source", "fingerprint"], "left_anti")


def stream_ingest(stream: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str, compact_every: int = COMPACT_EVERY):
    """Run ``extract`` on new or changed documents of each micro-batch; (path, content) rows in.

    Outcomes go to ``folder/results/run=R/batch=N`` (R: the id that the query keeps in its checkpoint), entries to ``folder/manifest``. Both are
    overwritten if a batch is repeated, from the state before it, so a restart loses and redoes nothing; a new checkpoint never
    overwrites what another wrote."""
    spark = stream.sparkSession
    log = ManifestLog(spark, f"{folder}/manifest")

    def batch(rows: DataFrame, number: int) -> None:
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        results = f"{folder}/results/run={run}/batch={number}"
        extract(new_documents(rows, log.before(run, number, compact_every))).write.mode("overwrite").parquet(results)
        files = F.array(F.concat(F.lit("out/"), F.col("source"), F.lit(".md")))
        now = F.lit(time.time_ns() // 1000)
        log.write(spark.read.parquet(results)
            .select("source", "fingerprint", "status", files.alias("output_files"), files.alias("owned_files"), now.alias("updated")),
            f"{folder}/manifest/delta/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def document_lifecycle(events: DataFrame) -> DataFrame:
    """S02, batch: (run_id, document_id, state, sequence): the latest event of each document; events of the run itself are none."""
    events = events.where(F.col("type").startswith("document."))
    return events.groupBy("run_id", "document_id").agg(F.max_by("type", F.struct("sequence", "type")).alias("state"), F.max("sequence").alias("sequence"))


def sequence_audit(events: DataFrame) -> DataFrame:
    """By run, gaps and repeats in its sequence, documents without a start and without a terminal event, and events after its end.

    A number without its predecessor starts a stretch, and stretches but the first lie behind a gap: sums by (run, number), so that no run is
    ordered in one task."""
    number = F.explode(F.array(F.struct(F.col("sequence").alias("s"), F.lit(1).alias("own")), F.struct((F.col("sequence") + 1).alias("s"), F.lit(0).alias("own")))).alias("n")
    places = events.select("run_id", number).groupBy("run_id", "n.s").agg(F.sum("n.own").alias("own"), F.bool_or(F.col("n.own") == 0).alias("follows"))
    gaps = places.where("own > 0").groupBy("run_id").agg((F.count_if(~F.col("follows")) - 1).alias("gaps"), F.sum(F.col("own") - 1).alias("repeats"), F.sum("own").alias("events"))
    docs = (events.where(F.col("type").startswith("document.")).groupBy("run_id", "document_id")
        .agg(F.bool_or(F.col("type") == "document.started").alias("started"), F.bool_or(F.col("type").isin(*TERMINAL)).alias("ended")))
    open_ = docs.groupBy("run_id").agg(F.count_if(~F.col("started")).alias("unstarted"), F.count_if(~F.col("ended")).alias("unended"))
    end = events.where(F.col("type").isin(*RUN_END)).groupBy("run_id").agg(F.min("sequence").alias("end"))
    late = events.join(end, "run_id").groupBy("run_id").agg(F.count_if(F.col("sequence") > F.col("end")).alias("late"))
    counts = ["gaps", "repeats", "events", "unstarted", "unended", "late"]
    return gaps.join(open_, "run_id", "left").join(late, "run_id", "left").select("run_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def running_usage(usage: DataFrame, cap: int) -> DataFrame:
    """Totals of each job and whether the cap is reached; the same on a stream (update mode) and a table."""
    g = usage.groupBy("job_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("requests"))
    return g.withColumn("cap_reached", F.col("input_tokens") + F.col("output_tokens") >= cap)
