"""Context operators on empty tables, nulls, ties and open ends."""

from pyspark.sql import functions as F

from chatloom.operators import context, evaluate, feed, gates


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbourhoods_of_nothing_are_empty(spark):
    none = spark.createDataFrame([], "c long, k long, ts timestamp_ntz, s string, a boolean, p long")
    assert context.turns_around(none, none, "c", "k", 2).count() == 0
    assert context.minutes_around(none, none, "c", "ts", 5).count() == 0
    assert context.same_sender_around(none, "c", "s", "k", "a", 1).count() == 0
    assert context.replies_around(none, none, "k", "p").count() == 0


def test_turns_keep_repeated_rows_and_stay_in_the_channel(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 4), (2, 1), (None, 1), (1, None)], "c long, k long")
    assert rows(context.turns_around(df, df.filter("c = 1 and k = 0"), "c", "k", 1)) == [(1, 0), (1, 1), (1, 1)]


def test_minutes_include_the_edge_across_slots(spark):
    df = spark.sql("select 1L c, id k, timestamp_ntz'2024-01-01 00:59:59' + make_interval(0, 0, 0, 0, 0, int(id), 0) ts from range(0, 30, 5)")
    assert [k for (k,) in rows(context.minutes_around(df, df.filter("k = 10"), "c", "ts", 10).select("k"))] == [0, 5, 10, 15, 20]


def test_replies_reach_parent_and_children_only(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 2), (6, 99)], "k long, p long")
    assert [k for (k,) in rows(context.replies_around(df, df.filter("k = 2"), "k", "p").select("k"))] == [1, 2, 3, 5]


def test_route_and_narrowing(spark):
    df = spark.createDataFrame([(None, None), ("", "dog"), ("trip", None), ("trip", "dog")], "c string, v string")
    assert [r[0] for r in df.select(context.route(F.col("c"), F.col("v"))).collect()] == ["structural", "visual", "context", "context"]
    ends = spark.createDataFrame([(1, None, 3, 9), (None, None, 2, None)], "a int, b int, c int, d int")
    low, high = context.narrowed(("a", "c"), ("b", "d"))
    assert [tuple(r) for r in ends.select(low, high).collect()] == [(3, 9), (2, None)]


def test_a_repeated_search_takes_no_cycle(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "a", "a"]), (1, 3, ["c"]), (1, 4, []), (2, 1, ["c"])], "r long, k long, w array<string>")
    assert rows(context.fresh_searches(df, "r", "k", "w", 2).select("r", "k", "cycle")) == [(1, 1, 1), (1, 3, 2), (2, 1, 1)]


def test_media_lookup_rules_in_order(spark):
    media = spark.createDataFrame([(1, "c", "f/session1/image/x.jpg"), (2, "c", "f/session2/image/x.jpg"), (3, "d", "f/session3/image/x.jpg"), (4, "c", None)], "media_id long, channel_id string, path string")
    asked = [(1, "c", "session1", "session2/x.jpg"), (2, "c", "session2", "x.jpg"), (3, "c", "session9", "x.jpg"), (4, "c", "session1", "y.jpg"), (5, "c", None, None)]
    df = spark.createDataFrame(asked, "question_id long, channel_id string, session string, image string")
    assert rows(context.resolve_media(df, media)) == [(1, 2, 1), (2, 2, 2), (3, 1, 3)]


def test_measures_reports_and_ordinals(spark):
    a, b = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "q long, k long"), spark.createDataFrame([(1, 2), (3, 1)], "q long, k long")
    assert [tuple(r) for r in evaluate.retrieval_metrics(a, b, "q", "k").orderBy("q").collect()] == [(1, 2, 1, 1.0, 0.5), (2, 1, 0, None, 0.0), (3, 0, 1, 0.0, None)]
    assert rows(gates.set_report(a.select("k"), b.select("k"), "k")) == [(5, "missing")]
    channels, newest = spark.createDataFrame([(1, 9), (2, None), (3, 4)], "channel_id long, last_ordinal long"), spark.createDataFrame([(1, 3), (2, 1)], "channel_id long, ordinal long")
    assert rows(feed.raised_last(channels, newest)) == [(1, 9), (2, 1), (3, 4)]


def test_clusters_beyond_the_size_give_no_edges(spark):
    members = spark.createDataFrame([("x", g) for g in "aab"] + [("y", str(k)) for k in range(11)] + [("z", "q")], "cluster string, g string")
    assert rows(evaluate.cluster_edges(members, "cluster", "g")) == [("a", "b")]


def test_answers_without_case_marks_and_articles(spark):
    df = spark.createDataFrame([("The  Cat, a dog!",), ("cat DOG",), (None,), ("theatre",)], "t string")
    assert [r[0] for r in df.select(evaluate.normalised_answer(F.col("t"))).collect()] == ["cat dog", "cat dog", None, "theatre"]


def test_bindings_are_checked_place_by_place(spark):
    known = spark.createDataFrame([("m", "h"), ("n", "g")], "message_id string, hash string")
    kind = "query_id string, gold_ids array<string>, bindings array<struct<message_id:string,message_hash:string>>"
    df = spark.createDataFrame([("ok", ["m", "n"], [("m", "h"), ("n", "g")]), ("c", ["m"], []), ("i", ["m", "n"], [("n", "g"), ("m", "h")]), ("h", ["m"], [("m", "x")]), ("u", ["z"], [("z", "h")])], kind)
    assert rows(gates.binding_violations(df, known)) == [("c", "count"), ("h", "hash"), ("i", "message_id"), ("i", "message_id"), ("u", "unknown_message")]
