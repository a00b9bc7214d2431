"""Sends as one transaction, refreshes of several tables, promotion behind gates, the manifest of an index."""

import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import commands, release
from chatloom.session import read_text, write_text

SEND = "send_id long, caller_id string, channel_id string, key string, text string, draft_ids array<long>"


def _state(spark):
    grants = spark.createDataFrame([("u", "x"), ("v", "x"), ("u", "y")], "caller_id string, channel_id string")
    drafts = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "v", "x")], "draft_id long, caller_id string, channel_id string")
    channels = spark.createDataFrame([("x", 4), ("y", None)], "channel_id string, last_ordinal long")
    return grants, drafts, channels, spark.createDataFrame([("u", "old", "sent", "x:live:3")], "caller_id string, key string, status string, message_id string")


def test_sends_are_committed_as_a_whole(spark):
    sends = [
        (1, "u", "x", "a", "hello", [1, 2]), (2, "u", "x", "a", "hello again", [1, 2]), (3, "v", "x", "a", "mine", []), (4, "u", "x", "old", "again", []), (5, "u", "z", None, "no grant", []), (6, "u", "x", None, "  ", []),
        (7, "u", "x", None, "taken", [2]), (8, "u", "x", None, "not mine", [3]), (9, "v", "x", None, "own", [3]), (10, "u", "y", None, "first", []), (11, None, None, None, None, None),
    ]
    found = {k: v.collect() for k, v in commands.committed_sends(spark.createDataFrame(sends, SEND), *_state(spark), 20).items()}
    got = {r["send_id"]: (r["status"], r["message_id"], r["replayed"]) for r in found["outcomes"]}
    assert got == {
        1: ("sent", "x:live:21", False), 2: ("sent", "x:live:21", True), 3: ("sent", "x:live:22", False), 4: ("sent", "x:live:3", True), 5: ("denied", None, False), 6: ("invalid", None, False),
        7: ("draft_conflict", None, False), 8: ("draft_conflict", None, False), 9: ("draft_conflict", None, False), 10: ("sent", "y:live:23", False), 11: ("invalid", None, False),
    }
    assert sorted((r["message_id"], r["ordinal"], r["feed_ordinal"]) for r in found["messages"]) == [("x:live:21", 5, 21), ("x:live:22", 6, 22), ("y:live:23", 0, 23)]
    assert sorted((r["message_id"], r["position"], r["draft_id"]) for r in found["bindings"]) == [("x:live:21", 0, 1), ("x:live:21", 1, 2)]
    assert sorted((r["event_id"], r["status"], r["attempt_count"]) for r in found["outbox"]) == [(21, "pending", 0), (22, "pending", 0), (23, "pending", 0)]
    none = commands.committed_sends(spark.createDataFrame([], SEND), *_state(spark), 20)
    assert all(df.count() == 0 for df in none.values())


def test_tables_are_seen_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    tables = {"channels": spark.createDataFrame([("x",)], "channel_id string"), "messages": spark.createDataFrame([("m", "x"), ("n", None)], "message_id string, channel_id string")}
    keys = {("messages", "channel_id"): ("channels", "channel_id")}
    first = release.publish_tables(tables, root, keys)
    assert release.current(spark, root, "messages").count() == 2
    wrong = tables | {"messages": spark.createDataFrame([("m", "gone")], "message_id string, channel_id string")}
    with pytest.raises(ValueError, match="1 rows of messages.channel_id"):
        release.publish_tables(wrong, root, keys)
    assert read_text(spark, f"{root}/CURRENT") == first and release.current(spark, root, "channels").count() == 1
    second = release.publish_tables(tables | {"channels": tables["channels"].limit(1).union(spark.createDataFrame([("y",)], "channel_id string"))}, root, keys, approve=False)
    report = lambda *ok: spark.createDataFrame([(x,) for x in ok], "passes boolean")
    for bad in (report(True, False), report(None), report()):
        with pytest.raises(ValueError, match="does not pass"):
            release.promote(spark, root, second, bad)
    assert release.current(spark, root, "channels").count() == 1
    release.promote(spark, root, second, report(True, True))
    assert release.current(spark, root, "channels").count() == 2
    with pytest.raises(ValueError, match="not finished"):
        release.promote(spark, root, "unknown")


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "note")
    for text in ("één", "two\nlines"):
        write_text(spark, path, text)
        assert read_text(spark, path) == text == (tmp_path / "note").read_text()
    write_text(spark, f"file://{path}", "by address")
    assert read_text(spark, path) == "by address" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["note"]


def test_index_manifest_binds_rows_in_key_order(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("message_id"), F.lit("1").alias("model_version"))
    path = str(tmp_path / "manifest.json")
    table = lambda df: {"vectors": (df, "message_id", ["model_version"])}
    first = release.index_manifest(spark, path, table(rows), {"model": "m"})
    assert json.loads((tmp_path / "manifest.json").read_text()) == first and first["tables"]["vectors"]["count"] == 50
    assert release.index_manifest(spark, path, table(rows.repartition(7)), {"model": "m"}) == first
    assert release.index_manifest(spark, path, table(rows.filter("message_id <> 7")), {"model": "m"}) != first
    assert release.index_manifest(spark, path, table(rows.limit(0)), {})["tables"]["vectors"] == {"count": 0, "sha256": None}
