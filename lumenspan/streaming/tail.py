"""Live tail: spans in the order in which they were admitted, and streaming extensions."""

from __future__ import annotations

import threading
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.filters import SpanFilter


class Gap(Exception):
    """A cursor that the ring can't continue from."""


@dataclass
class Ring:
    """The newest spans, in admission order; the oldest go first when it is full."""

    epoch: str
    most_spans: int = 8192
    most_bytes: int = 32 << 20
    head: int = 0
    _held: deque = field(default_factory=deque)
    _bytes: int = 0
    _lock: threading.Condition = field(default_factory=threading.Condition)

    def admit(self, rows: list[Row], skipped: int = 0) -> None:
        """Takes the newest rows of a batch; ``skipped`` older ones of it are counted, so that readers see the gap."""
        with self._lock:
            if skipped:
                self._held.clear()
                self._bytes = 0
                self.head += skipped
            for r in rows:
                size = sum(len(str(x)) for x in r) + 64
                self._held.append((self.head, size, r))
                self.head += 1
                self._bytes += size
            while len(self._held) > self.most_spans or self._bytes > self.most_bytes:
                self._bytes -= self._held.popleft()[1]
            self._lock.notify_all()

    def backfill(self, n: int = 200) -> int:
        """The cursor from which the newest ``n`` spans follow."""
        with self._lock:
            return max(self.head - min(n, len(self._held)), 0)

    def read(self, epoch: str, seq: int, limit: int = 1000, wait_s: float = 0) -> tuple[list[Row], int]:
        """Spans from ``seq`` on, and the next cursor; it advances over spans that a reader's filter then rejects."""
        with self._lock:
            if epoch != self.epoch:
                raise Gap("the cursor is of another epoch")
            if seq > self.head:
                raise Gap("the cursor is ahead of the head")
            first = self._held[0][0] if self._held else self.head
            if seq < first:
                raise Gap(f"spans before {first} are gone")
            if seq == self.head and wait_s:
                self._lock.wait(wait_s)
            found = [r for s, _, r in self._held if s >= seq][:limit]
            return found, seq + len(found)


def tail(spans: DataFrame, f: SpanFilter, ring: Ring, checkpoint: str, attributes: str = "attributes") -> StreamingQuery:
    """Runs a stream of admitted spans into ``ring``.

    Event-time bounds are refused: the tail is about admission, not about when
    spans began.  Within a micro-batch spans keep their write numbers' order.
    """
    if f.since_ns is not None or f.until_ns is not None or f.cursor or f.sort:
        raise ValueError("a tail has no bounds of event time, cursor or sort")
    matched = spans.where(f.column(attributes))

    def admit(batch: DataFrame, _: int) -> None:
        rows = batch.orderBy("ingest_seq") if "ingest_seq" in batch.columns else batch
        # the ring keeps no more than this, so no more is brought to the driver
        kept = rows.tail(ring.most_spans)
        ring.admit(kept, batch.count() - len(kept) if len(kept) == ring.most_spans else 0)

    return matched.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).start()


def series_stream(spans: DataFrame, width: str, late: str) -> DataFrame:
    """Extension: counts and errors per window of event time, with a watermark for late spans."""
    at = spans.withColumn("start_ts", F.expr("timestamp_micros(start_time_ns div 1000)")).withWatermark("start_ts", late)
    return at.groupBy(F.window("start_ts", width).alias("w")).agg(F.count("*").alias("spans"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"))


def session_stream(spans: DataFrame, idle: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: runs of a session, ended by idleness."""
    at = spans.withColumn("start_ts", F.expr("timestamp_micros(start_time_ns div 1000)")).withWatermark("start_ts", late)
    return at.where("session_id IS NOT NULL").groupBy("tenant", "session_id", F.session_window("start_ts", idle).alias("w")).agg(F.count("*").alias("spans"))
