"""Work leased to one worker at a time, and replay of stored events before live ones.

A queue is a key of the stream, so its jobs are handed out in one order and never twice at once. Queues should be many (a queue for each channel,
or for some hash of it); the jobs of one queue pass one task.

Defined cases: a claim of an empty queue, or with every job held, is `empty`; a job added twice is one job; `done` and `renew` by one who does not hold
the job are `stale` and change nothing; a lease ends at its moment, so a row at that moment comes too late; rows without queue or time are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatloom.operators.scope import scoped
from chatloom.session import exists

OUTCOMES = "queue string, job string, worker string, outcome string, at_ms long, attempt int"
#: In one moment jobs are added first and finished before new claims are answered.
_ORDER = {"add": 0, "done": 1, "renew": 2, "claim": 3}


class Leases(StatefulProcessor):
    """Oldest job first. A lease that runs out puts its job back at its old place; finished jobs are remembered for a while, so that repeats add nothing."""

    def __init__(self, lease_ms: int, remember_ms: int):
        self.lease_ms, self.remember_ms = lease_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getMapState("waiting", "place long", "job string, attempt int")
        self.held = handle.getMapState("held", "job string", "worker string, until long, place long, attempt int")
        self.known = handle.getMapState("known", "job string", "until long")

    def _returned(self, queue: str, now: int) -> list[tuple]:
        """Jobs whose lease has ended by now go back to where they stood."""
        over = [(job[0], *held) for job, held in self.held.iterator() if held[1] <= now]
        for job, _, _, place, attempt in over:
            self.held.removeKey((job,))
            self.waiting.updateValue((place,), (job, attempt))
        return [(queue, job, worker, "returned", until, attempt) for job, worker, until, _, attempt in sorted(over, key=lambda x: (x[2], x[0]))]

    def _finished(self, queue: str, job: str, worker: str, kind: str, at: int) -> list[tuple]:
        held = self.held.getValue((job,)) if self.held.containsKey((job,)) else None
        if held is None or held[0] != worker:
            return [(queue, job, worker, "stale", at, 0)]
        if kind == "renew":
            self._lease(job, worker, at, held[2], held[3])
            return [(queue, job, worker, "renewed", at, held[3])]
        self.held.removeKey((job,))
        self.known.updateValue((job,), (at + self.remember_ms,))
        self.handle.registerTimer(at + self.remember_ms)
        return [(queue, job, worker, "done", at, held[3])]

    def _lease(self, job: str, worker: str, at: int, place: int, attempt: int) -> None:
        self.held.updateValue((job,), (worker, at + self.lease_ms, place, attempt))
        self.handle.registerTimer(at + self.lease_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        queue, out = key[0], []
        got = pd.concat(list(rows))
        got = sorted(zip(got["at_ms"].tolist(), got["kind"].tolist(), got["job"].tolist(), got["worker"].tolist(), strict=True), key=lambda x: (x[0], _ORDER.get(x[1], 9), str(x[2]), str(x[3])))
        for at, kind, job, worker in got:
            out += self._returned(queue, at)
            if kind == "add":
                n = self.count.get()[0] if self.count.exists() else 0
                if not self.known.containsKey((job,)):
                    self.known.updateValue((job,), (-1,))  # until it is done
                    self.waiting.updateValue((n,), (job, 0))
                    self.count.update((n + 1,))
            elif kind in ("done", "renew"):
                out += self._finished(queue, job, worker, kind, at)
            elif kind == "claim":
                first = min((p[0] for p in self.waiting.keys()), default=None)
                if first is None:
                    out.append((queue, None, worker, "empty", at, 0))
                    continue
                own, attempt = self.waiting.getValue((first,))
                self.waiting.removeKey((first,))
                self._lease(own, worker, at, first, attempt + 1)
                out.append((queue, own, worker, "granted", at, attempt + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = self._returned(key[0], now)
        for job in [job for job, until in self.known.iterator() if 0 <= until[0] <= now]:
            self.known.removeKey(job)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def leases(stream: DataFrame, lease_ms: int = 60_000, remember_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """Outcomes of (queue, kind, job, worker, at timestamp) rows: granted, empty, done, renewed, stale, and returned as leases run out by the watermark."""
    rows = stream.filter("queue is not null and at is not null").withWatermark("at", late)
    rows = rows.select("queue", "kind", "job", "worker", F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("queue").transformWithStateInPandas(Leases(lease_ms, remember_ms), OUTCOMES, "Append", "EventTime")


def subscribe(stored: Callable[[], DataFrame], live: DataFrame, cursor: int, grants: Callable[[], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes", every: str | None = None):
    """Stored events after the cursor, then live ones, each once: (event_id, ordinal, channel_id, at, ...).

    The live stream is fixed before the replay, and events that the replay has sent are left out of it, so none is lost or sent twice at
    the hand-over; repeats in the stream go by state within the watermark. Scope is that of the moment of each sending. send gets batch -1 for the replay; it
    should be idempotent by batch, as a batch that broke off is sent again. every: a polling interval; without it what is there is taken once.
    """
    spark = live.sparkSession
    mark = f"{checkpoint}/replayed"
    if not exists(spark, f"{mark}/_SUCCESS"):
        rows = stored().filter(F.col("ordinal") > cursor)
        last = rows.agg(F.coalesce(F.max("ordinal"), F.lit(cursor)).alias("last")).first()["last"]
        send(scoped(rows.filter(F.col("ordinal") <= last), grants()), -1)
        spark.range(1).select(F.lit(cursor).cast("long").alias("cursor"), F.lit(last).cast("long").alias("last")).write.mode("overwrite").parquet(mark)
    low, high = spark.read.schema("cursor long, last long").parquet(mark).first()

    def take(batch: DataFrame, k: int) -> None:
        sent = stored().filter(F.col("ordinal").between(low + 1, high)).select("event_id")
        fresh = batch.filter(F.col("ordinal") > low).join(sent, "event_id", "left_anti")
        send(scoped(fresh, grants()), k)

    once = live.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    writer = once.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/live")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
