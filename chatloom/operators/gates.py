"""Checks of released rows, multisets and traces. Every outcome is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import HARD_FAIL, REVIEW, SECRET, matches
from chatloom.operators.release import ordered_digests


def gold_violation() -> Column:
    """Null for a row that meets its contract, else what it breaks."""
    media, answer = F.size(F.coalesce("gold_media_ids", F.array().cast("array<string>"))) > 0, F.trim(F.coalesce("gold_answer", F.lit(""))) != ""
    is_media, action = F.coalesce("answer_is_media", F.lit(False)), F.col("expected_action")
    targets = F.size(F.coalesce("acceptable_clarification_targets", F.array().cast("array<string>"))) > 0
    return (
        F.when(F.coalesce("query_id", F.lit("")) == "", "query_id")
        .when((action == "return_result") & is_media & (~media | answer), "media_answer")
        .when((action == "return_result") & ~is_media & (media | ~answer), "text_answer")
        .when((action == "clarify") & (media | answer | ~targets), "clarify")
        .when((action == "no_result") & (media | answer), "no_result")
        .when(~action.isin("return_result", "clarify", "no_result") | action.isNull(), "unknown_action")
    )


def gold_contract(rows: DataFrame) -> DataFrame:
    """(query_id, violation) of rows that break the contract or repeat an id."""
    again = F.when(F.count("*").over(Window.partitionBy("query_id")) > 1, "repeated_id")
    return rows.select("query_id", F.coalesce(gold_violation(), again).alias("violation")).filter("violation is not null")


def vocabulary_gate(rows: DataFrame, key: str, texts: list[str], patterns: tuple[str, ...] = HARD_FAIL) -> DataFrame:
    """(key, patterns) with the numbers of patterns found in the joined texts."""
    found = matches(F.concat_ws("\n", *texts), patterns)
    return rows.select(key, found.alias("patterns")).filter(F.size("patterns") > 0)


def vocabulary_outcomes(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, outcome, patterns): rows that fail for internal vocabulary in any of their texts, and those only to be reviewed."""
    text = F.concat_ws("\n", *texts)
    found = rows.select(key, matches(text, HARD_FAIL).alias("_hard"), matches(text, REVIEW).alias("_soft"))
    hard = F.size("_hard") > 0
    return found.filter(hard | (F.size("_soft") > 0)).select(key, F.when(hard, "fail").otherwise("review").alias("outcome"), F.when(hard, F.col("_hard")).otherwise(F.col("_soft")).alias("patterns"))


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right) where the counts differ; one full outer join of pre-aggregated counts."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return count(left, "n_left").join(count(right, "n_right"), key, "full").select(key, zero("n_left"), zero("n_right")).filter("n_left <> n_right")


def set_report(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): wanted keys that are missing, found keys that are extra."""
    side = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return side(wanted, found, "missing").unionByName(side(found, wanted, "extra"))


def binding_violations(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(query_id, violation): evidence bindings that do not match their row's gold ids place by place, or their message's hash.

    rows: (query_id, gold_ids array, bindings array of (message_id, message_hash)); messages: (message_id, hash).
    """
    count = rows.filter(F.size("gold_ids") != F.size("bindings")).select("query_id", F.lit("count").alias("violation"))
    each = rows.filter(F.size("gold_ids") == F.size("bindings")).select("query_id", F.explode(F.arrays_zip("gold_ids", "bindings")).alias("z"))
    each = each.select("query_id", F.col("z.gold_ids").alias("_gold"), F.col("z.bindings.message_id").alias("_bound"), F.col("z.bindings.message_hash").alias("_hash"))
    known = messages.select(F.col("message_id").alias("_gold"), F.col("hash").alias("_known"), F.lit(True).alias("_there"))
    wrong = F.when(~F.col("_bound").eqNullSafe(F.col("_gold")), "message_id").when(F.col("_there").isNull(), "unknown_message").when(~F.col("_hash").eqNullSafe(F.col("_known")), "hash")
    return count.unionByName(each.join(known, "_gold", "left").select("query_id", wrong.alias("violation")).filter("violation is not null"))


def trace_violations(trace: DataFrame) -> DataFrame:
    """(event_id, violation) of a trace (pos, query_id, event_id, parent_event_id, record_type, action, outcome, block_reason, result_event_id, payload)."""
    # Record types, actions and reasons of a trace.
    kinds = ("query_started", "round", "result", "llm_call", "query_completed")
    actions = ("retrieve_lexical", "retrieve_dense", "retrieve_visual", "filter_metadata", "expand_context", "extract_clues", "resolve_bridge", "jump", "vlm_extract", "stop")
    reasons = ("no_unused_clue", "visited_query_fingerprint", "no_information_gain", "budget_exhausted")
    unknown = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    is_round, is_jump = F.col("record_type") == "round", (F.col("record_type") == "round") & (F.col("action") == "jump")
    own = (
        F.when(unknown("record_type", kinds), "record_type")
        .when(is_round & unknown("action", actions), "action")
        .when(is_jump & unknown("outcome", ("executed", "blocked")), "outcome")
        .when(is_jump & (F.col("outcome") == "blocked") & unknown("block_reason", reasons), "block_reason")
        .when((F.col("record_type") == "query_completed") & (F.coalesce(F.col("outcome") == "answered", F.lit(False)) != F.col("result_event_id").isNotNull()), "result_reference")
        .when(F.coalesce(F.col("payload"), F.lit("")).rlike(SECRET), "secret")
    )
    alone = trace.select("event_id", F.coalesce(own, F.when(F.count("*").over(Window.partitionBy("event_id")) > 1, "repeated_id")).alias("violation"))
    known = trace.select(F.col("event_id").alias("_id"), F.col("query_id").alias("_query"), F.col("pos").alias("_pos"), F.col("record_type").alias("_type"))
    child = trace.filter("parent_event_id is not null")
    parent = child.join(known, child["parent_event_id"] == known["_id"], "left").groupBy("event_id", "pos", "query_id").agg(F.max(((F.col("_query") == F.col("query_id")) & (F.col("_pos") < F.col("pos"))).cast("int")).alias("ok")).filter("ok is null or ok = 0").select("event_id", F.lit("parent").alias("violation"))
    done = trace.filter("record_type = 'query_completed' and result_event_id is not null")
    final = done.join(known, done["result_event_id"] == known["_id"], "left").groupBy("event_id", "query_id").agg(F.max(((F.col("_query") == F.col("query_id")) & (F.col("_type") == "result")).cast("int")).alias("ok")).filter("ok is null or ok = 0").select("event_id", F.lit("final_result").alias("violation"))
    return alone.filter("violation is not null").unionByName(parent).unionByName(final)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


#: What is wrong with a visual artifact, in the order it is looked at.
ARTIFACT_CODES = ("MEDIA_INPUT_SET_MISMATCH", "VISUAL_MODEL_MISMATCH", "VISUAL_PREPROCESSING_MISMATCH", "VISUAL_DEVICE_MISMATCH", "MATRIX_SHA256_MISMATCH", "MEDIA_COUNT_MISMATCH")


def artifact_error(matches_: list[Column]) -> Column:
    """The first code whose test does not hold; null for a sound artifact. matches_: a test for each code."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in zip(matches_, ARTIFACT_CODES, strict=True)), F.lit(None).cast("string"))


def artifact_manifests(media: DataFrame, matrix: DataFrame) -> DataFrame:
    """(artifact, media_input_sha256, media_count, matrix_sha256, matrix_rows) as the data has them.

    media: (artifact, media_id, content); matrix: (artifact, media_id, vector).
    """
    inputs = ordered_digests(media, "artifact", "media_id", ["content"]).select("artifact", F.col("digest").alias("media_input_sha256"), F.col("n").alias("media_count"))
    vectors = ordered_digests(matrix.withColumn("_v", F.array_join(F.col("vector").cast("array<string>"), " ")), "artifact", "media_id", ["_v"])
    return inputs.join(vectors.select("artifact", F.col("digest").alias("matrix_sha256"), F.col("n").alias("matrix_rows")), "artifact", "full")


def artifact_errors(manifests: DataFrame, media: DataFrame, matrix: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(artifact, code) of every manifest, code null for a sound one: manifests are held against what the media and the matrix digest to now.

    manifests: (artifact, media_input_sha256, media_count, matrix_sha256, model_name, model_version, preprocessing, device).
    """
    now = artifact_manifests(media, matrix)
    now = now.select("artifact", *(F.col(c).alias(f"_{c}") for c in now.columns if c != "artifact"))
    both = manifests.join(now, "artifact", "left")
    same = lambda c, other: F.col(c).eqNullSafe(other)
    tests = [
        same("media_input_sha256", F.col("_media_input_sha256")),
        same("model_name", F.lit(expected["model_name"])) & same("model_version", F.lit(expected["model_version"])),
        same("preprocessing", F.lit(expected["preprocessing"])),
        same("device", F.lit(expected["device"])),
        same("matrix_sha256", F.col("_matrix_sha256")),
        same("media_count", F.col("_matrix_rows")),
    ]
    return both.select("artifact", artifact_error(tests).alias("code"))


def returning(rows: DataFrame) -> DataFrame:
    """Gold rows that expect a result."""
    return rows.filter("expected_action = 'return_result'")
