"""Digests in key order, exact percentiles without lists, answers that are rejected, artifacts with faults."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import evaluate, gates, release, windows


def _plain_digest(lines, fan, levels):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    for _ in range(levels):
        level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_digest_follows_the_order_of_keys_alone(spark, fan):
    rows = [("a", k, f"t{k}") for k in range(26)] + [(None, k, None) for k in range(3)] + [("b", 7, "x")]
    want = {}
    for g in ("a", None, "b"):
        own = sorted(x for x in rows if x[0] == g)
        want[g] = (len(own), _plain_digest(["\0".join([str(k), "\1" if v is None else v]) for _, k, v in own], fan, 5))
    for seed in (1, 2):
        mixed = random.Random(seed).sample(rows, len(rows))
        got = release.ordered_digests(spark.createDataFrame(mixed, "g string, k long, v string").repartition(seed * 2), "g", "k", ["v"], fan, 5)
        assert {r["g"]: (r["n"], r["digest"]) for r in got.collect()} == want
    with pytest.raises(Exception, match="levels"):
        release.ordered_digests(spark.createDataFrame(rows, "g string, k long, v string"), "g", "k", ["v"], 2, 3).collect()
    assert release.ordered_digests(spark.createDataFrame([], "g string, k long, v string"), "g", "k", ["v"]).count() == 0


def test_percentiles_equal_sorted_lists_and_build_none(spark):
    r = random.Random(3)
    rows = [(g, float(r.randrange(9)) if r.random() < 0.9 else None) for g in ["a"] * 500 + ["b", "b", None, None, None] for _ in range(1)] + [("c", None), ("d", 4.0)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    places = {"t95": evaluate.truncating(0.95), "p50": evaluate.positional(0.5), "p100": evaluate.positional(1.0), "t0": evaluate.truncating(0.0)}
    got = evaluate.values_at(table, "g", "v", places)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        if own:
            n = len(own)
            want[g] = (own[max(0, int(0.95 * n - 1))], own[min(n - 1, int(n * 0.5))], own[-1], own[0])
    assert {x["g"]: (x["t95"], x["p50"], x["p100"], x["t0"]) for x in got.collect()} == want
    assert evaluate.values_at(table.filter("g = 'none'"), "g", "v", places).count() == 0


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(7)
    got = {r["k"]: (r["w"], r["before"]) for r in windows.global_running(rows, ["k"], "w").collect()}
    total = 0
    for k in range(1000):
        assert got[k][1] == total
        total += got[k][0]


def test_bare_answers_and_preambles_are_rejected(spark):
    rows = [("Where?", "Yes"), ("Where?", " no "), ("Where?", "true"), ("Where?", ""), ("Where?", None), ("Where?", "None of them"), ("Based on the chat, where?", "a door"), ("Where?", "according to him, a door"), ("Where is photo_3?", "a door"), ("Where?", "yes, a door"), (None, "nonetheless")]
    table = spark.createDataFrame(rows, "q string, a string")
    assert [r[0] for r in table.select(T.rejection(F.col("q"), F.col("a"))).collect()] == ["answer"] * 6 + ["preamble"] * 2 + ["vocabulary", None, None]
    assert [r[0] for r in table.select(T.rejected(F.col("a"))).collect()] == [True] * 6 + [False] * 5


def test_every_fault_of_an_artifact_is_found(spark):
    media = spark.createDataFrame([(a, k, f"{a}{k}") for a in "xy" for k in range(4)], "artifact string, media_id long, content string")
    matrix = spark.createDataFrame([(a, k, [float(k), 1.0]) for a in "xy" for k in range(4)], "artifact string, media_id long, vector array<double>")
    expected = {"model_name": "m", "model_version": "1", "preprocessing": "p", "device": "cpu"}
    sound = gates.artifact_manifests(media, matrix).drop("matrix_rows").withColumns({c: F.lit(v) for c, v in expected.items()})
    code = lambda manifests, m=media, x=matrix: {r["artifact"]: r["code"] for r in gates.artifact_errors(manifests, m, x, expected).collect()}
    assert code(sound) == {"x": None, "y": None}
    assert code(sound, media.filter("not (artifact = 'x' and media_id = 2)")) == {"x": "MEDIA_INPUT_SET_MISMATCH", "y": None}
    assert code(sound.withColumn("model_version", F.lit("2")))["y"] == "VISUAL_MODEL_MISMATCH"
    assert code(sound.withColumn("preprocessing", F.lit(None).cast("string")))["y"] == "VISUAL_PREPROCESSING_MISMATCH"
    assert code(sound.withColumn("device", F.lit("gpu")))["y"] == "VISUAL_DEVICE_MISMATCH"
    changed = matrix.withColumn("vector", F.when((F.col("artifact") == "y") & (F.col("media_id") == 3), F.array(F.lit(0.5), F.lit(1.0))).otherwise(F.col("vector")))
    assert code(sound, media, changed) == {"x": None, "y": "MATRIX_SHA256_MISMATCH"}
    assert code(sound.withColumn("media_count", F.lit(9)))["x"] == "MEDIA_COUNT_MISMATCH"
    assert code(sound, media.filter("artifact = 'x'"), matrix.filter("artifact = 'x'"))["y"] == "MEDIA_INPUT_SET_MISMATCH"


def test_split_of_many_components(spark):
    rows = spark.range(100_000).select(F.col("id").alias("component"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("stratum"), (F.col("id") * 7 % 5 + 1).alias("n"))
    quotas = {"a": 30_000, "b": 31_000, "c": 29_500}
    split = evaluate.assign_splits(rows, 120_001, quotas, "x")
    sums = {}
    for r in rows.collect():
        if split[r["component"]] == "dev":
            sums[r["stratum"]] = sums.get(r["stratum"], 0) + r["n"]
    assert len(split) == 100_000 and sum(sums.values()) == 120_001 and all(abs(sums[s] - q) <= 0.15 * q for s, q in quotas.items())


def test_split_takes_the_first_choice_that_meets_all(spark):
    import itertools

    for seed in range(6):
        r = random.Random(seed)
        own = [(f"c{k}", r.choice("ab"), r.randrange(1, 12)) for k in range(9)]
        quotas = {"a": sum(n for _, s, n in own if s == "a") // 2, "b": sum(n for _, s, n in own if s == "b") // 2}
        total = sum(n for *_, n in own) // 2
        order = sorted(own, key=lambda x: (hashlib.sha256(f"s:{x[0]}".encode()).hexdigest(), x[0]))
        want = None
        for take in itertools.product([True, False], repeat=9):
            dev = [x for x, t in zip(order, take, strict=True) if t]
            if sum(x[2] for x in dev) == total and all(abs(sum(x[2] for x in dev if x[1] == s) - q) <= max(8, int(0.15 * q)) for s, q in quotas.items()):
                want = {x[0] for x in dev}
                break
        table = spark.createDataFrame(own, "component string, stratum string, n long")
        if want is None:
            with pytest.raises(ValueError, match="no assignment"):
                evaluate.assign_splits(table, total, quotas, "s")
        else:
            assert {c for c, x in evaluate.assign_splits(table, total, quotas, "s").items() if x == "dev"} == want


def test_letters_beyond_latin_1_fold(spark):
    names = ["Nguyễn", "Đức", "ő", "ș", "ż", "ZŁOTY", "e\u0301", "Ångström", "ß", "中", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, n string")
    assert [r[0] for r in rows.orderBy("k").select(T.folded_accents(F.col("n"))).collect()] == ["nguyen", "duc", "o", "s", "z", "zloty", "e", "angstrom", "ß", "中", None]
    pairs = spark.createDataFrame([("Đức", "duc"), ("ễ", "E"), ("a", "b"), ("Zołć", "ZOLC")], "a string, b string")
    assert [r[0] for r in pairs.select(T.any_accent(F.col("a")) == T.any_accent(F.col("b"))).collect()] == [True, True, False, True]
