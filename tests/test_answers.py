"""Expansion to one side, measures of answers, fusion, exports, chunk headers."""

import json

from pyspark.sql import functions as F

from chatloom.operators import chunks, evaluate, lexical
from chatloom.sources import files


def test_expansion_is_cut_at_the_ends_of_the_document(spark):
    table = spark.createDataFrame([("d", k) for k in range(20)] + [("e", 0)], "d string, i long")
    cols = "d string, first_index long, last_index long, center_index long, level int, direction string"
    rows = [("d", 8, 9, 8, 0, "both"), ("d", 8, 9, 8, 1, "none"), ("d", 8, 9, 8, 2, "both"), ("d", 8, 9, 8, 2, "forward"), ("d", 8, 9, 8, 3, "backward"), ("d", 8, 9, 9, 3, "forward"), ("d", 1, 2, 1, 3, "both"), ("e", 0, 0, 0, 2, None)]
    got = [(r["d"], r["level"], r["direction"], r["low"], r["high"], r["truncated"]) for r in chunks.directed_ranges(spark.createDataFrame(rows, cols), table, "d", "i").collect()]
    assert sorted(got, key=str) == sorted([("d", 1, "none", 8, 9, False), ("d", 2, "both", 6, 10, False), ("d", 2, "forward", 8, 13, False), ("d", 3, "backward", 0, 9, True), ("d", 3, "forward", 8, 19, False), ("d", 3, "both", 0, 6, True), ("e", 2, None, 0, 0, False)], key=str)
    ranges = spark.createDataFrame([(1, "d", 1, 0, 4), (1, "d", 2, 3, 9), (2, "d", 1, 0, 0)], "q long, d string, r long, low long, high long")
    kept = sorted((r["q"], r["chunk_index"], r["r"]) for r in chunks.output_chunks(ranges, "q", "d", "r", 7).collect())
    assert kept == [(1, k, 1 if k < 5 else 2) for k in range(7)] + [(2, 0, 1)]


def test_measures_of_answers(spark):
    schema = "gold_media array<string>, answer_media array<string>, retrieved_media array<string>, gold_evidence array<string>, context_ids array<string>, gold_bridges array<string>, bridges array<string>, constraints array<boolean>"
    rows = [(["a", "b"], ["b", "a"], ["a", "x", "b"], ["m"], ["m", "n"], ["p"], [], [True, False]), (["a"], None, None, [], [], None, None, None), ([], ["a"], ["a"], ["k", "l"], ["k", "k"], ["p", "q"], ["q"], [None, True])]
    got = {r["metric"]: (r["value"], r["sample_size"]) for r in evaluate.answer_metrics(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {"exact_media_accuracy": (0.5, 2), "media_recall_at_k": (0.25, 2), "evidence_recall": (0.75, 2), "context_precision": (0.75, 2), "bridge_recall": (0.25, 2), "constraint_satisfaction": (0.5, 2)}
    assert {r["sample_size"] for r in evaluate.answer_metrics(spark.createDataFrame([], schema)).collect()} == {0}


def test_fusion_scales_each_question(spark):
    rows = spark.createDataFrame([(1, "b", 1.0, 5.0), (1, "a", 3.0, 5.0), (1, "c", None, 5.0), (2, "a", 7.0, None)], "q long, m string, x double, y double")
    got = [(r["q"], r["m"], r["score"], r["rank"]) for r in lexical.minmax_fusion(rows, "q", "m", {"x": 0.5, "y": 0.5}).orderBy("q", "rank").collect()]
    assert got == [(1, "a", 0.5, 1), (1, "b", 0.0, 2), (1, "c", 0.0, 3), (2, "a", 0.0, 1)]


def test_overlap_in_blocks_of_queries(spark):
    queries = spark.createDataFrame([(1, "red fox", "fox"), (2, "blue", None), (3, None, "fox"), (4, "red red dog", "dog cat")], "q long, a string, b string")
    docs = spark.createDataFrame([(1, "The RED fox"), (2, "dog, red cat"), (3, None), (4, "blue blue"), (None, "red fox")], "k long, t string")
    want = [(1, 1, 1.0, 14), (2, 4, 1.0, 6), (4, 2, 1.0, 16)]
    for most in (1, 4096):
        assert sorted(tuple(r) for r in lexical.token_overlap(queries, docs, "q", "a", "b", "k", "t", 0.75, most).collect()) == want


def test_exports_keep_nulls_and_order(spark, tmp_path):
    rows = spark.range(100).select((99 - F.col("id")).alias("b"), F.when(F.col("id") % 2 == 0, F.lit("é\n")).alias("a")).repartition(5)
    for files_ in (1, 4, None):
        out = tmp_path / f"out{files_}"
        files.write_jsonl(rows, ["b"], str(out), files_)
        lines = [json.loads(x) for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
        assert [x["b"] for x in lines] == list(range(100)) and all(list(x) == ["a", "b"] for x in lines) and {x["a"] for x in lines} == {None, "é\n"}


def test_headers_name_the_day_and_lines_their_images(spark):
    rows = spark.createDataFrame([("c", 0, "u", "hi", ["m1", "m2"], "2026-01-02"), ("c", 1, None, None, None, "2026-01-03")], "c string, o long, s string, t string, media array<string>, day string").withColumns({"chunk_index": F.lit(0).cast("long"), "n_tokens": F.lit(1).cast("long")})
    text = lambda **more: chunks.chunk_table(rows, "c", "o", "s", "t", **more).first()["text"]
    assert text(day="day", media="media") == "[conversation:c] [day:2026-01-02]\nu: hi [image:m1] [image:m2]\nunknown: " and text() == "[conversation:c]\nu: hi\nunknown: "
