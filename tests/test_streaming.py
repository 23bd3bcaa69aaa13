"""Streams with state of their own against their batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.streaming import jobs, stateful

EVENTS = "run_id long, sequence long, document_id long, type string, ts timestamp"


def test_spans_equal_sets():
    rng = random.Random(1)
    for _ in range(50):
        spans, seen = stateful.Spans([]), set()
        for n in (rng.randrange(30) for _ in range(40)):
            assert spans.add(n) == (n not in seen)
            seen.add(n)
            spans = stateful.Spans(spans.all())
        gaps = sum(n + 1 not in seen for n in seen) - 1
        assert len(spans.all()) == gaps + 1 and all(spans.above(k) == sum(n > k for n in seen) for k in range(-1, 31))


def run(spark, frames, folder, make, query, restart_after=None):
    """The last row of each key after all ``frames`` came one by one, with a restart from the checkpoint between two of them."""
    out = []

    def keep(rows, number):
        out.extend(rows.collect())

    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if restart_after is None or i in (restart_after, len(frames) - 1):
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            make(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/{query}").trigger(availableNow=True).start().awaitTermination(240)
    return out


def test_sequence_audit_stream_equals_its_batch_form(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["document.started", "document.progress", "document.completed", "document.failed", "run.started", "run.completed"]
    rows = [(r, rng.randrange(25), rng.choice([1, 2, 3, None]), rng.choice(kinds), datetime(2024, 1, 1)) for r in (1, 2) for _ in range(30)] + [(3, 5, 9, "document.started", datetime(2024, 1, 1))]
    rng.shuffle(rows)
    frames = [spark.createDataFrame(rows[i : i + 25], EVENTS) for i in range(0, len(rows), 25)]
    out = run(spark, frames, str(tmp_path), stateful.sequence_audit_stream, "audit", restart_after=0)
    last = {r["run_id"]: tuple(r) for r in out}
    names = [c.split()[0] for c in stateful.AUDIT.split(", ")]
    want = {r["run_id"]: tuple(r) for r in jobs.sequence_audit(spark.createDataFrame(rows, EVENTS).where("document_id is not null or type like 'run.%'")).select(*names).collect()}
    kept = [r for r in rows if r[2] is not None or r[3].startswith("run.")]
    assert len(kept) < len(rows)
    again = run(spark, [spark.createDataFrame(kept, EVENTS)], str(tmp_path / "kept"), stateful.sequence_audit_stream, "audit")
    assert {r["run_id"]: tuple(r) for r in again} == want and last.keys() == want.keys()


def test_stuck_documents_and_restart(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    frames = [[(1, 1, 7, "document.started", at(0)), (1, 2, 8, "document.started", at(1))],
        [(1, 3, 8, "document.completed", at(50)), (1, 4, 9, "document.started", at(400))],
        [(1, 5, 9, "document.progress", at(405)), (1, 6, 9, "document.progress", at(100))], [(1, 7, 5, "document.completed", at(900))]]
    out = run(spark, [spark.createDataFrame(f, EVENTS) for f in frames], str(tmp_path), stateful.lifecycle_stream, "life", restart_after=1)
    seen = [(r["document_id"], r["state"], r["sequence"]) for r in out]
    assert (7, "stuck", 1) in seen and seen.count((7, "stuck", 1)) == 1 and (8, "stuck", 2) not in seen
    assert seen.index((7, "document.started", 1)) < seen.index((7, "stuck", 1)) and (8, "document.completed", 3) in seen and (9, "document.progress", 5) in seen


def test_lifecycle_stream_equals_its_batch_form(spark, tmp_path):
    from quire.views import Inputs
    from tests.conftest import SF

    events = Inputs(spark, SF)("run_events").select("run_id", "sequence", "document_id", "type", F.col("ts").cast("timestamp").alias("ts"))
    out = run(spark, [events], str(tmp_path), stateful.lifecycle_stream, "life")
    got = {(r["run_id"], r["document_id"]): (r["state"], r["sequence"]) for r in out if r["state"] != "stuck"}
    assert got == {(r["run_id"], r["document_id"]): (r["state"], r["sequence"]) for r in jobs.document_lifecycle(events).collect()}
