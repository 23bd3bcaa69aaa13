"""Streams with state of their own: live sequence audit and document lifecycle, each equal to its batch form in :mod:`quire.streaming.jobs`.

State lives in RocksDB, which these processors need: :func:`use_rocksdb` sets the session's store.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.streaming.jobs import RUN_END, TERMINAL, TIMEOUT_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AUDIT = "run_id long, gaps long, repeats long, events long, unstarted long, unended long, late long"
LIFECYCLE = "run_id long, document_id long, state string, sequence long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Spans:
    """Numbers that were seen, as runs without a gap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.low, self.high = [a for a, _ in sorted(spans)], [b for _, b in sorted(spans)]

    def add(self, n: int) -> bool:
        """Whether ``n`` is new."""
        at = bisect_right(self.low, n)  # the first run that begins behind n
        if at and self.high[at - 1] >= n:
            return False
        after, before = at < len(self.low) and self.low[at] == n + 1, at > 0 and self.high[at - 1] == n - 1
        if after and before:
            self.high[at - 1] = self.high.pop(at)
            self.low.pop(at)
        elif after:
            self.low[at] = n
        elif before:
            self.high[at - 1] = n
        else:
            self.low.insert(at, n)
            self.high.insert(at, n)
        return True

    def above(self, n: int) -> int:
        """How many seen numbers are larger than ``n``."""
        at = bisect_left(self.high, n + 1)
        return sum(b - max(a, n + 1) + 1 for a, b in zip(self.low[at:], self.high[at:]))

    def all(self) -> list[tuple[int, int]]:
        return list(zip(self.low, self.high))


class SequenceAudit(StatefulProcessor):
    """Of a run: the spans of its numbers, how often more than once a number came, the number of its end, and of each document whether it began and ended.

    The state of a run's numbers is bounded by its gaps and repeats; where ``keep_ms`` is given, all of it goes so long after it was last written."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getListState("spans", "low long, high long", ttlDurationMs=self.keep_ms)
        self.again = handle.getMapState("again", "sequence long", "times long", ttlDurationMs=self.keep_ms)
        self.ends = handle.getValueState("ends", "sequence long", ttlDurationMs=self.keep_ms)
        self.documents = handle.getMapState("documents", "document_id long", "started boolean, ended boolean", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = Spans([(a, b) for a, b in self.spans.get()])
        again = {k[0]: v[0] for k, v in self.again.iterator()}
        end = self.ends.get()[0] if self.ends.exists() else None
        documents = {k[0]: tuple(v) for k, v in self.documents.iterator()}
        repeated, touched = set(), set()
        for batch in rows:
            for n, kind, document in zip(batch["sequence"], batch["type"], batch["document_id"]):
                n = int(n)
                if not spans.add(n):
                    again[n] = again.get(n, 0) + 1
                    repeated.add(n)
                if kind in RUN_END:
                    end = n if end is None else min(end, n)
                if kind.startswith("document.") and not pd.isna(document):
                    began, over = documents.get(int(document), (False, False))
                    documents[int(document)] = (began or kind == "document.started", over or kind in TERMINAL)
                    touched.add(int(document))
        self.spans.put(spans.all())
        for n in repeated:
            self.again.updateValue((n,), (again[n],))
        for d in touched:
            self.documents.updateValue((d,), documents[d])
        if end is not None:
            self.ends.update((end,))
        repeats = sum(again.values())
        events = sum(b - a + 1 for a, b in spans.all()) + repeats
        late = 0 if end is None else spans.above(end) + sum(t for n, t in again.items() if n > end)
        flags = list(documents.values())
        out = (key[0], len(spans.low) - 1, repeats, events, sum(not a for a, _ in flags), sum(not b for _, b in flags), late)
        yield pd.DataFrame([out], columns=[c.split()[0] for c in AUDIT.split(", ")])

    def close(self) -> None:
        pass


def sequence_audit_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """S03, streaming: the rows of :func:`quire.streaming.jobs.sequence_audit` in update mode, whatever the order in which events arrive. A null sequence is no event.

    With ``keep_ms`` the state of a run goes so long (by the clock) after its last event; such a stream never ends by itself,
    as a trigger of what is available now would."""
    use_rocksdb(events.sparkSession)
    keyed = events.where("sequence is not null").select("run_id", "sequence", "document_id", F.coalesce("type", F.lit("")).alias("type")).groupBy("run_id")
    return keyed.transformWithStateInPandas(SequenceAudit(keep_ms), AUDIT, "Update", "None" if keep_ms is None else "ProcessingTime")


class Lifecycle(StatefulProcessor):
    """Of a document: its latest event, and a timer for as long as that isn't terminal."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "state string, sequence long, last_ms long")

    def _row(self, key, state: str, sequence: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], state, sequence)], columns=[c.split()[0] for c in LIFECYCLE.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, sequence, last = self.latest.get() if self.latest.exists() else ("", -1, 0)
        for batch in rows:
            for t, s, ts in zip(batch["type"], batch["sequence"], batch["ts"]):
                sequence, kind = max((sequence, kind), (int(s), t))
                last = max(last, int(ts.timestamp() * 1000))
        self.latest.update((kind, sequence, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kind not in TERMINAL:
            self.handle.registerTimer(max(last + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, kind, sequence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, sequence, _ = self.latest.get()
        self.latest.clear()
        yield self._row(key, "stuck", sequence)

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, late: str = "10 seconds") -> DataFrame:
    """S02, streaming: the rows of :func:`quire.streaming.jobs.document_lifecycle` in update mode; a document without a terminal event for ``timeout_seconds`` of event time is
    ``stuck``, once. Events later than ``late`` are dropped."""
    use_rocksdb(events.sparkSession)
    keyed = events.where(F.col("type").startswith("document.")).select("run_id", "document_id", "type", "sequence", "ts").withWatermark("ts", late).groupBy("run_id", "document_id")
    return keyed.transformWithStateInPandas(Lifecycle(timeout_seconds * 1000), LIFECYCLE, "Update", "EventTime")
