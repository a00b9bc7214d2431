"""Every query on a table with nulls, blanks, long texts, repeats and clashing columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm.catalog import QUERIES
from chatloom.llm.language_id import learn_profiles
from chatloom.llm.quality_rules import clean_lines

LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000)) + "."
TEXT = "The quick brown fox of the north is running to the lazy dog with a happy cat and another fox in the garden of the old house."
ITEM = "one benchmark question about the colour of seven distant planets and their moons"
ROWS = [
    (1, TEXT, "en", "src0"), (1, TEXT, "en", "src0"), (2, None, "en", "src0"), (3, "", None, "src0"), (4, LONG, "en", None), (5, TEXT, None, None), (None, TEXT, "en", "src0"), (None, None, None, None),
    (7, " \n\t ", "fr", "src1"), (8, "12 34 !!", "fr", "src1"), (9, "Licensed under the Apache License, Version 2.0.", "en", "src1"), (10, f"{TEXT} {ITEM}", "en", "src1"), (11, "\U0001f600 \U00020000 ä́", "de", "src2"), (32, "Released under the MIT License.", "en", "src1"),
]
EXTRA = ("y", "grp", "h", "word", "votes", "unit", "n", "fp", "_words", "n_words", "path", "rows", "score", "start", "component_id")
ONE_PER_ROW = [q for q in QUERIES if q.split("_")[0] in ("op3", "op4", "op5", "op6", "op7", "op8", "op10", "op12", "op13")]


def _write(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], (r[0] or 0) % 2, 0) for r in rows] + ([(1, 0, 1), (None, None, None), (12345, 1, 1)] if rows else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, ITEM), (1, None), (2, ""), (None, ITEM)] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", ONE_PER_ROW)
def test_a_row_for_every_row(spark, odd, name):
    got = sorted(str(r["doc_id"]) for r in QUERIES[name](spark, odd).collect())
    assert got == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_both(spark, odd, empty):
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_defined_results(spark, odd):
    by = lambda name: {r["doc_id"]: r for r in QUERIES[name](spark, odd).collect() if r["doc_id"] is not None}
    lang = by("op3_language_id")
    assert all(lang[k]["lang_pred"] == "und" and lang[k]["score"] == 0 for k in (2, 3, 7, 8))
    rules = by("op5_quality_rules")
    assert [rules[k]["n_words"] for k in (2, 3, 7, 8)] == [0, 0, 0, 3] and not rules[2]["kept"] and rules[1]["kept"]
    prints = by("op10_simhash")
    assert {prints[k]["fingerprint"] for k in (2, 3, 7)} == {"0" * 16} and {prints[k]["component_id"] for k in (2, 3, 7)} == {2} and prints[5]["component_id"] == 1
    lm = by("op6_language_model")
    assert [lm[k]["n_tokens"] for k in (2, 3, 7, 8)] == [1, 1, 1, 4]
    found = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, odd).collect()}
    assert found == {10}
    licence = by("op4_license_scan")
    assert licence[9]["own_license"] == "Apache-2.0" and licence[32]["license"] == "MIT" and licence[2]["license"] is None
    pieces = QUERIES["op1_packing"](spark, odd).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 2) == 1 and sum(r["length"] for r in pieces if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in pieces if r["doc_id"] == 1)
    assert all(0 <= r["score"] <= 1 for n in ("op7_toxicity", "op8_quality_classifier") for r in QUERIES[n](spark, odd).collect())


@pytest.mark.parametrize("end", ["", "\r"])
def test_a_lone_capital_before_a_small_letter(spark, end):
    first, rest = f"12 34 B 56{end}", "foo bar and so on it goes with many more plain words until there are at least twenty of them in all here"
    rows = spark.createDataFrame([(1, f"{first}\n{rest}"), (2, first)], "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in clean_lines(rows).collect()}
    assert got == {1: rest, 2: ""}


def test_every_language_has_a_profile(spark):
    docs = spark.range(1100).select(F.col("id").alias("doc_id"), F.format_string("words of language %d", "id").alias("text"), F.format_string("l%d", "id").alias("lang"))
    assert len(learn_profiles(docs, F.lit(True))) == 1100
