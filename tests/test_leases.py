"""Leases over lost workers and restarts; replay, then live events."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chatloom.streaming import conversations as C
from chatloom.streaming import leases as L

ROWS = "queue string, kind string, job string, worker string, at timestamp"
EVENTS = "event_id string, ordinal long, channel_id string, at timestamp"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _at(seconds):
    return datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)


def _feed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_one_holder_over_a_lost_worker_and_restarts(rocks, tmp_path):
    spark, src, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    parts = [
        [("q", "add", "a", None, 0), ("q", "add", "b", None, 1), ("q", "add", "a", None, 2), ("q", "claim", None, "w1", 3), ("q", "claim", None, "w2", 4), ("q", "claim", None, "w3", 5), ("other", "claim", None, "w1", 5)],
        [("q", "done", "b", "w2", 6), ("q", "done", "b", "w1", 6), ("q", "renew", "a", "w2", 7)],  # w1 is lost from here on
        [("q", "claim", None, "w3", 20), ("q", "done", "a", "w1", 21), ("q", "renew", "a", "w3", 25), ("q", "add", "c", None, 26), ("q", "add", "b", None, 27)],
        [("q", "done", "a", "w3", 33), ("q", "claim", None, "w1", 34), (None, "claim", None, "w1", 34)],
        [("other", "add", "z", None, 100)],
        [("other", "add", "y", None, 101)],
    ]
    for part in parts:  # each run is a restart from the checkpoint
        _feed(spark, [(*r[:4], _at(r[4])) for r in part], ROWS, src)
        stream = L.leases(C.messages(spark, src, ROWS), lease_ms=10_000)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    base = int(_at(0).timestamp() * 1000)
    got = [((r["at_ms"] - base) // 1000, r["queue"], r["job"], r["worker"], r["outcome"], r["attempt"]) for r in spark.read.schema(L.OUTCOMES).parquet(out).collect()]
    assert sorted(got, key=str) == sorted([
        (3, "q", "a", "w1", "granted", 1), (4, "q", "b", "w2", "granted", 1), (5, "q", None, "w3", "empty", 0), (5, "other", None, "w1", "empty", 0), (6, "q", "b", "w2", "done", 1), (6, "q", "b", "w1", "stale", 0),
        (7, "q", "a", "w2", "stale", 0), (13, "q", "a", "w1", "returned", 1), (20, "q", "a", "w3", "granted", 2), (21, "q", "a", "w1", "stale", 0), (25, "q", "a", "w3", "renewed", 2), (33, "q", "a", "w3", "done", 2),
        (34, "q", "c", "w1", "granted", 1), (44, "q", "c", "w1", "returned", 1),
    ], key=str)
    holder = {}
    for _, queue, job, worker, outcome, _ in sorted(got, key=lambda x: (x[0], ["returned", "done", "renewed", "stale", "empty", "granted"].index(x[4]))):
        if outcome == "granted":
            assert (queue, job) not in holder
            holder[queue, job] = worker
        elif outcome in ("done", "returned"):
            assert holder.pop((queue, job)) == worker


def test_replay_then_live_over_a_restart_and_a_revoked_grant(rocks, tmp_path):
    spark, src, log, sent = rocks, str(tmp_path / "live"), str(tmp_path / "log"), []
    grants = {"a", "b"}
    event = lambda k: (f"e{k}", k, "ab"[k % 2], _at(k))
    _feed(spark, [event(k) for k in range(10)], EVENTS, log)
    _feed(spark, [event(k) for k in (2, 7, 8, 9, 10, 11, 11)], EVENTS, src)

    def run():
        live = C.messages(spark, src, EVENTS)
        allowed = lambda: spark.createDataFrame([(c,) for c in sorted(grants)], "channel_id string")
        query = L.subscribe(lambda: spark.read.schema(EVENTS).parquet(log), live, 3, allowed, lambda df, k: sent.append((k, sorted(r["ordinal"] for r in df.collect()))), str(tmp_path / "cp"))
        assert query.awaitTermination(240)

    run()
    assert sent[0] == (-1, [4, 5, 6, 7, 8, 9]) and sorted(x for k, own in sent[1:] for x in own) == [10, 11]
    grants.remove("b")
    del sent[:]
    _feed(spark, [event(k) for k in (9, 10, 12, 13, 14, 3)], EVENTS, src)  # repeats of the replay and of an earlier batch
    _feed(spark, [event(k) for k in range(10, 15)], EVENTS, log)
    run()
    assert all(k >= 0 for k, _ in sent) and sorted(x for _, own in sent for x in own) == [12, 14]
