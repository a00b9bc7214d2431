import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import chunks
from chatloom.streaming import conversations as C

SCHEMA = "channel_id string, ordinal long, text string"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(stream, path, checkpoint):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    spark, src = rocks, str(tmp_path / "in")
    rows = [(f"c{k % 2}", k, "w " * (k % 5)) for k in range(40)]
    out = str(tmp_path / "out")
    for part in (rows[:25], rows[20:]):  # the second file repeats messages
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        _run(C.chunk_stream(C.messages(spark, src, SCHEMA), most_messages=4, most_tokens=9), out, str(tmp_path / "cp"))
    want = chunks.greedy_chunks(spark.createDataFrame(rows, SCHEMA), "channel_id", "ordinal", "text", 4, 9).select("channel_id", "ordinal", "chunk_index")
    got = spark.read.schema(C.PLACED).parquet(out).select("channel_id", "ordinal", "chunk_index")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordered_delivery_waits_for_gaps(rocks, tmp_path):
    spark, src, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    order = list(range(12))
    random.Random(2).shuffle(order)
    for part in (order[:6], order[4:11]):
        spark.createDataFrame([("c", k, "") for k in part], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        _run(C.ordered_stream(C.messages(spark, src, SCHEMA)), out, str(tmp_path / "cp"))
    shown = sorted(r["ordinal"] for r in spark.read.schema(C.SHOWN).parquet(out).collect())
    assert shown == list(range(order[11]))  # everything before the one that never came


def test_latency(spark):
    at = lambda s: F.to_timestamp_ntz(F.lit(f"2026-01-01 00:00:{s}"))
    got = C.visibility_latency(spark.range(1).select(F.col("id").alias("event_id"), at("01").alias("acked_at")), spark.range(1).select(F.col("id").alias("event_id"), at("02.5").alias("committed_at"))).first()
    assert got["latency_ms"] == 1500.0
