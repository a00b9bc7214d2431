import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import chunks, evaluate, feed, gates, normalize, release, scope, similarity, windows
from chatloom.operators.graph import connected_components
from chatloom.plans import catalog
from chatloom.sources import files


def test_sequence_ids_of_a_large_stratum(spark):
    rows = windows.sequence_id(spark.range(1, 10_102).select("id", F.lit(1).alias("s")), "s", ["id"])
    got = {r["id"]: r["query_id"] for r in rows.collect()}
    assert got == {k: f"q_1_{k:04d}" for k in range(1, 10_102)}


def test_evidence_of_every_item(spark, tmp_path):
    spark.range(-3, 10_500).select(F.col("id").alias("item_id")).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(23).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["diverse_evidence"](spark, str(tmp_path)).collect()))
    assert got == [(k, -7 * k % 23) for k in range(-3, 10_500)]


def test_chunk_limits_and_long_first_message(spark):
    rows = [("c", k, "w " * n) for k, n in enumerate([500, 1, 10, 395, 1, 399, 1])]
    got = chunks.greedy_chunks(spark.createDataFrame(rows, "ch string, o long, t string"), "ch", "o", "t").orderBy("o").collect()
    assert [r["chunk_index"] for r in got] == [0, 1, 1, 2, 2, 3, 3]


def test_chunks_do_not_depend_on_input_order(spark):
    rows = [(f"c{k % 3}", k, "w " * (k % 7)) for k in range(200)]
    one = chunks.greedy_chunks(spark.createDataFrame(rows, "ch string, o long, t string"), "ch", "o", "t", 5, 12)
    random.Random(1).shuffle(rows)
    two = chunks.greedy_chunks(spark.createDataFrame(rows, "ch string, o long, t string").repartition(5), "ch", "o", "t", 5, 12)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 302), (302, 301)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in range(100, 140)} == {100} and got[200] == 200 and {got[k] for k in (300, 301, 302)} == {300}


def test_components_of_random_graphs_and_none(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_scope_denies_by_default(spark):
    m = spark.createDataFrame([("u", "a", "2020-01-01", None), ("u", "b", "2020-01-01", "2021-01-01"), ("u", "c", "2030-01-01", None)], "caller_id string, channel_id string, valid_from string, valid_to string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "channel_id string")
    now = F.lit("2022-01-01")
    assert {r[0] for r in scope.scoped(rows, scope.grants_of(m, "u", now)).collect()} == {"a", "c"}
    assert {r[0] for r in scope.scoped(rows, scope.grants_of(m, "u", now, check_start=True)).collect()} == {"a"}
    assert scope.scoped(rows, scope.grants_of(m, "nobody", now)).count() == 0


def test_limits_and_cursors():
    assert [feed.clamp_limit(n) for n in (0, -1, 1, 500, 501)] == [100, 100, 1, 500, 100]
    with pytest.raises(ValueError):
        feed.cursor(1, 2)


def test_diverse_evidence_replays_the_visit(spark):
    # The fourth row is of a new session, so it is taken although three are, and ends the visit.
    rows = spark.createDataFrame([("q", 1, 10), ("q", 1, 9), ("q", 1, 8), ("q", 2, 7), ("q", 3, 6)], "q string, s int, score int")
    got = windows.diverse_evidence(rows, "q", "s", [F.desc("score")]).collect()
    assert sorted(r["score"] for r in got) == [7, 8, 9, 10]


def test_negative_gaps_do_not_split(spark):
    rows = spark.sql("select 'c' ch, o, timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, m) ts from values (1, 0), (2, 5), (3, 11), (4, 100) as t(o, m)")
    got = windows.gap_segments(rows, "ch", "ts", "o", 5).orderBy("o").collect()
    assert [r["segment"] for r in got] == [0, 0, 1, 2]


def test_slug_and_chunk_id(spark):
    r = spark.createDataFrame([("Dr. O'Neil", "c:1", ["c:1:s:0", "c:1:s:5"])], "n string, c string, m array<string>").select(T.sender_slug(F.col("n")), T.chunk_id(F.col("c"), F.col("m")), T.chunk_id(F.col("c"), F.array().cast("array<string>"))).first()
    assert tuple(r) == ("sender_dr_dot_o_apostrophe_neil", "c:1:s:0-s:5", "c:1:empty")


def test_normalisation_end_to_end(spark, tmp_path):
    for family, d, s, day, turns in (("two-party", 1, 1, "Monday", ["A_OldMeng", "Everyone"]), ("two-party", 1, 2, "Sunday", ["Vicky"])):
        folder = tmp_path / family / f"dialogue{d}" / "scenes" / f"session{s}"
        folder.mkdir(parents=True)
        (folder / "a.png").write_bytes(b"x" * s)
        body = [{"role": r, "content": {"text": "hi @OldMeng, and more", "image": "a.png" if k == 0 and s == 1 else None}} for k, r in enumerate(turns)]
        (folder / "session.json").write_text(json.dumps({"session_id": f"s{s}", "timeline_date": day, "dialogue": body}))
    dates = spark.createDataFrame([("Monday", "2026-01-05"), ("Sunday", "2026-01-04")], "raw string, day string")
    aliases = spark.createDataFrame([("Vic", "Vicky")], "alias string, name string")
    m = normalize.messages(files.sessions(spark, str(tmp_path)), dates, aliases).cache()
    rows = m.orderBy("chronological_rank").collect()
    assert [r["message_id"] for r in rows] == ["dyadic_d1:session1:0", "dyadic_d1:session1:1", "dyadic_d1:session2:0"]
    assert rows[0]["display_name"] == "Old Meng" and rows[1]["sender_id"] is None and rows[1]["timestamp"] == "2026-01-05T09:01:30+07:00"
    assert all(r["temporal_order_conflict"] for r in rows)
    images = files.images(spark, str(tmp_path))
    media = normalize.media(m, images)
    assert media.count() == 1 and normalize.orphans(images, media).count() == 1
    names = spark.createDataFrame([("Old Meng", "s1", 1.0), ("Old", "s2", 1.0)], "name string, sender_id string, confidence double")
    found = normalize.mentions(m, names).collect()
    assert len(found) == 3 and all(r["sender_id"] == "s1" and r["confidence"] == 0.5 and (r["start"], r["end"]) == (3, 11) for r in found)
    with pytest.raises(Exception, match="no mapping"):
        normalize.messages(files.sessions(spark, str(tmp_path)), dates.filter("raw = 'Monday'"), aliases).count()


def test_all_aliases_and_dates_count(spark):
    n = 100_500
    s = spark.createDataFrame([("two-party/dialogue1/scenes/session1/session.json", "s1", f"day{n - 1}", [(f"role{n - 1}", ("hi", None))])], "path string, session_id string, timeline_date string, dialogue array<struct<role:string,content:struct<text:string,image:string>>>")
    ids = spark.range(n)
    dates = ids.select(F.format_string("day%d", "id").alias("raw"), F.lit("2026-01-05").alias("day"))
    aliases = ids.select(F.format_string("role%d", "id").alias("alias"), F.format_string("Name %d", "id").alias("name"))
    assert [r["display_name"] for r in normalize.messages(s, dates, aliases).collect()] == [f"Name {n - 1}"]


def test_gold_contract_controls(spark):
    kind = "query_id string, expected_action string, gold_media_ids array<string>, gold_answer string, answer_is_media boolean, acceptable_clarification_targets array<string>"
    good = [("1", "return_result", [], "x", False, []), ("2", "return_result", ["m"], "", True, []), ("3", "clarify", [], "", False, ["t"]), ("4", "no_result", None, None, None, None)]
    bad = [("5", "return_result", ["m"], "x", True, []), ("6", "clarify", [], "", False, []), ("7", "other", [], "", False, []), ("8", "no_result", [], "x", False, []), ("9", "no_result", [], "", False, []), ("9", "no_result", [], "", False, [])]
    assert gates.gold_contract(spark.createDataFrame(good, kind)).count() == 0
    assert sorted(r[0] for r in gates.gold_contract(spark.createDataFrame(bad, kind)).collect()) == ["5", "6", "7", "8", "9", "9"]


def test_splits_meet_quotas_and_ignore_order(spark):
    r = random.Random(5)
    rows = [(f"c{k}", s, r.randrange(1, 4)) for k in range(20) for s in ("a", "b")]
    total = sum(n for _, _, n in rows)
    quotas = {"a": total // 4, "b": total // 4}
    one = evaluate.assign_splits(spark.createDataFrame(rows, "component string, stratum string, n int"), total // 2, quotas, "salt")
    r.shuffle(rows)
    assert one == evaluate.assign_splits(spark.createDataFrame(rows, "component string, stratum string, n int"), total // 2, quotas, "salt")
    assert sum(n for c, _, n in rows if one[c] == "dev") == total // 2
    with pytest.raises(ValueError):
        evaluate.assign_splits(spark.createDataFrame(rows, "component string, stratum string, n int"), total + 1, quotas, "salt")


def test_release_pointer_and_tampering(spark, tmp_path):
    rows = spark.range(10)
    name = release.publish(rows, str(tmp_path))
    assert release.current(spark, str(tmp_path)).count() == 10
    release.publish(spark.range(3), str(tmp_path), approve=False)
    assert release.current(spark, str(tmp_path)).count() == 10
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/releases/{name}")
    with pytest.raises(ValueError, match="changed"):
        release.current(spark, str(tmp_path))


def test_config_hash_ignores_volatile_keys():
    assert release.config_hash({"a": 1.0, "run_id": "x", "b": {"timestamp": 3, "c": [0.1 + 0.2]}}) == release.config_hash({"b": {"c": [0.3]}, "a": 1.0})


def test_empty_trace_has_null_values(spark):
    kind = "record_type string, query_id string, event_id string, action string, outcome string, role string, supporting array<string>, used array<string>, gained array<string>, anchors array<string>, result_event_id string, latency_ms double, cost_usd string"
    got = evaluate.trace_metrics(spark.createDataFrame([], kind)).collect()
    assert len(got) == 13 and all(r["value"] is None and r["sample_size"] == 0 for r in got)


def test_vector_blocks_equal_one_block(spark):
    v = np.random.default_rng(0).normal(size=(60, 8))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    one = {tuple(r)[:2] for r in similarity.cosine_pairs(rows, "id", "v", 0.5).collect()}
    many = [tuple(r)[:2] for r in similarity.cosine_pairs(rows, "id", "v", 0.5, block=7).collect()]
    assert one == set(many) and len(many) == len(one) > 0


def test_perceptual_hash_of_shifted_brightness():
    x = np.random.default_rng(1).integers(0, 200, (32, 32))
    a, b = similarity.perceptual_hash(x), similarity.perceptual_hash(x + 20)
    assert bin(a ^ b).count("1") <= 1


def test_kappa(spark):
    assert evaluate.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 1), (0, 0)], "a int, b int"), "a", "b") == 1.0
    assert abs(evaluate.kappa(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "a int, b int"), "a", "b")) < 1e-12


def test_splits_keep_every_component_whatever_its_strata(spark):
    rows = [(f"c{k:04}", f"s{j}", 1) for k in range(1500) for j in range(4)]
    got = evaluate.assign_splits(spark.createDataFrame(rows, "component string, stratum string, n int"), 3000, {"s0": 750, "s1": 750}, "salt")
    assert len(got) == 1500 and sum(v == "dev" for v in got.values()) == 750


def test_owner_grants_of_more_viewers_than_a_block(spark):
    viewers = spark.range(30).select(F.col("id").alias("caller_id"))
    channels = spark.range(5).select(F.col("id").alias("channel_id"))
    held = channels.filter("channel_id = 2").join(viewers.filter("caller_id < 10").select("caller_id"), F.lit(True))
    assert scope.missing_owner_grants(viewers, channels, held, block=7).count() == 150 - 10


def test_redaction_keeps_what_stands_before_a_key(spark):
    rows = spark.createDataFrame([("key: sk-abcdefghij.",), ("sk-short",), ("Bearer abc.def tail",)], "t string")
    assert [r[0] for r in rows.select(T.redacted(F.col("t"))).collect()] == ["key: [REDACTED].", "sk-short", "[REDACTED] tail"]


def test_sequence_ids_stay_distinct_beyond_four_digits(spark):
    rows = spark.range(12_000).select("id", F.lit("a").alias("stratum"))
    assert windows.sequence_id(rows, "stratum", ["id"]).select("query_id").distinct().count() == 12_000
